"""Date detection and date parts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts of dates in text columns, tried in this order.
DATE_LAYOUTS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
)


# Text that each part of a layout stands for.
_PARTS = {
    "yyyy": "[+-]?[0-9]{4,19}", "MM": "[0-9]{2}", "dd": "[0-9]{2}", "HH": "[0-9]{2}", "mm": "[0-9]{2}", "ss": "[0-9]{2}",
    "SSSSSS": "[0-9]{1,6}", "'T'": "[Tt]", "XXX": "(?:[+-][0-9]{2}:[0-9]{2}|[Zz])",
}
# No text that starts otherwise, or is longer, has a layout; most texts are told apart by this.
_OPENING = "^[+-]?[0-9]{2}"
_LONGEST = 64


def shape(layout: str) -> str | None:
    """Regular expression of the texts that can be a date in the layout; None if it has parts of unknown shape."""
    parts = re.findall("|".join(sorted(_PARTS, key=len, reverse=True)) + "|.", layout)
    if any(p not in _PARTS and (p.isalpha() or p in "'[]") for p in parts):
        return None
    return "^" + "".join(_PARTS.get(p, f"[{p}]") for p in parts) + "$"


def has_shape(c: Column, layouts=DATE_LAYOUTS) -> Column:
    """Whether a text can be a date in one of the layouts, judged without parsing it."""
    shapes = [shape(layout) for layout in layouts]
    if None in shapes:
        return c.isNotNull()
    return (F.length(c) <= _LONGEST) & c.rlike(_OPENING) & c.rlike("|".join(shapes))


def parse_date(c: Column, layouts=DATE_LAYOUTS) -> Column:
    """Timestamp of a text in one of the layouts, else null.

    A failing parse costs an exception, so a text is only parsed in the layouts whose shape it has.
    """
    parsed = []
    for layout in layouts:
        moment, known = F.try_to_timestamp(c, F.lit(layout)), shape(layout)
        parsed.append(F.when(c.rlike(known), moment) if known else moment)
    return F.when(has_shape(c, layouts), F.coalesce(*parsed))


def whole_days(first: Column, last: Column) -> Column:
    """Completed 24-hour days between two timestamps (not calendar days)."""
    micros = F.unix_micros(last) - F.unix_micros(first)
    return F.floor(micros / F.lit(86_400_000_000))


def iso_text(c: Column) -> Column:
    """ISO 8601 text of a timestamp, with a fraction only where there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(exact)
