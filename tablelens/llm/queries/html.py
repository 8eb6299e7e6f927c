from __future__ import annotations

from ..common import read
from ..html import report
from .registry import query


@query("op3_html")
def op3_html(spark, sf_dir):
    """SQL has no markup parser; tested against hand-made pages and an alignment by brute force."""
    return report(read(spark, sf_dir, "pages"))
