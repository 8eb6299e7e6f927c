from __future__ import annotations

from ..common import read
from ..simhash import report
from .registry import query


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    """SQL has no XXH64; tested against all pairs instead."""
    return report(read(spark, sf_dir, "documents"))
