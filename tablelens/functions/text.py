"""Text expressions that Spark's own functions do not give directly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings longer than this are compared by digest where only equality matters.
LONG_TEXT = 64


def strip_space(c: Column) -> Column:
    """Remove every kind of white space at both ends; ``trim`` removes spaces only."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def title_case(c: Column) -> Column:
    """Capitalise each run of cased letters; ``initcap`` looks at blanks only."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def equality_key(c: Column) -> Column:
    """A short stand-in for a long string where only equality is asked.

    Shuffling the SHA-256 digest instead of the text bounds the width of the
    rows that duplicate and distinct counts move.  The sign before the digest
    makes it longer than any text that stands for itself.
    """
    return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)
