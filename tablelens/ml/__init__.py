"""Model search, evaluation and batch scoring with ``pyspark.ml``."""
