from __future__ import annotations

from ..common import read
from ..quality import report
from .registry import query


@query("op2_quality")
def op2_quality(spark, sf_dir):
    """A fitted model: tested by held-out accuracy."""
    return report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
