"""Operators for building training data from a corpus: mixing, filtering, deduplication, search, extraction."""

import sys

from pyspark import cloudpickle

# The tasks' functions travel whole, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
