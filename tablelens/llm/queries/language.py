from __future__ import annotations

from ..common import read
from ..language import report
from .registry import query


@query("op8_language")
def op8_language(spark, sf_dir):
    """A fitted model: tested by held-out accuracy."""
    return report(read(spark, sf_dir, "documents"))
