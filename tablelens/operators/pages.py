"""Pages of an ordered table, however far back, without ordering what lies before them.

A few keys of the table, drawn at random, cut its order into ranges.  One scan
counts the rows before each of them, which tells the range that holds the
page's first row; it is cut again until it is small.  Then the page's first key
is read from that range, and the page is the first rows from that key on: every
task sends on as many rows as the page has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows up to which a page is the end of the ordered beginning, and that the range with its first row may have.
RANGE = 10_000
# Ranges per scan, and keys drawn for each.
RANGES, DRAWN = 64, 16


@dataclass(frozen=True)
class Order:
    """One column of an order."""

    column: Column
    descending: bool = False
    nulls_first: bool = True

    def sorted(self) -> Column:
        c = self.column
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def before(self, value: Any) -> Column:
        """Whether a cell comes before ``value``."""
        if value is None:
            return F.lit(False) if self.nulls_first else self.column.isNotNull()
        less = self.column > F.lit(value) if self.descending else self.column < F.lit(value)
        return F.coalesce(less, F.lit(self.nulls_first))


def before(order: Sequence[Order], key: Sequence[Any]) -> Column:
    """Whether a row comes before a key, column by column."""
    out = F.lit(False)
    for o, value in reversed(list(zip(order, key, strict=True))):
        out = o.before(value) | (o.column.eqNullSafe(F.lit(value)) & out)
    return out


def _keys(df: DataFrame, order: Sequence[Order]) -> DataFrame:
    return df.select(*[o.column.alias(f"k{i}") for i, o in enumerate(order)])


def _sorted(df: DataFrame, order: Sequence[Order]) -> DataFrame:
    return df.orderBy(*[o.sorted() for o in order])


def _cuts(df: DataFrame, order: Sequence[Order], rows: int) -> list[tuple]:
    """Up to ``RANGES`` keys of a table of so many rows, in order, at about equal distances."""
    drawn = _keys(df, order).sample(min(1.0, RANGES * DRAWN / rows), seed=7)
    ordered = [Order(F.col(f"k{i}"), o.descending, o.nulls_first) for i, o in enumerate(order)]
    keys = list(dict.fromkeys(tuple(r) for r in _sorted(drawn, ordered).collect()))
    step = max(1, len(keys) // RANGES)
    return keys[step // 2 :: step]


def first_key(df: DataFrame, order: Sequence[Order], offset: int) -> tuple[tuple | None, int]:
    """The key of the row behind ``offset`` others, and how many rows of the same key come before it; None beyond the end."""
    rest, start = df, 0  # the range that is looked at, and how many rows come before it
    rows = df.count()
    if offset >= rows:
        return None, 0
    while rows > RANGE:
        cuts = _cuts(rest, order, rows)
        row = rest.agg(*[F.count_if(before(order, k)).alias(f"n{i}") for i, k in enumerate(cuts)]).first() if cuts else ()
        below = [(k, start + n) for k, n in zip(cuts, row, strict=True)]
        low = max((x for x in below if x[1] <= offset), key=lambda x: x[1], default=(None, start))
        high = min((x for x in below if x[1] > offset), key=lambda x: x[1], default=(None, start + rows))
        if low[0] is not None:
            rest = rest.where(~before(order, low[0]))
        if high[0] is not None:
            rest = rest.where(before(order, high[0]))
        same = high[1] - low[1] == rows
        start, rows = low[1], high[1] - low[1]
        if same and cuts:  # most rows of the range have one key
            equal = rest.agg(F.count_if(before(order, cuts[0])), F.count_if(~before(order, cuts[0]) & _is(order, cuts[0]))).first()
            upto = start + equal[0] + equal[1]
            if start + equal[0] <= offset < upto:
                return cuts[0], offset - start - equal[0]
            if offset >= upto:  # what is sought lies behind them
                rest, rows, start = rest.where(~before(order, cuts[0]) & ~_is(order, cuts[0])), start + rows - upto, upto
            else:
                rest, rows = rest.where(before(order, cuts[0])), equal[0]
    ordered = [Order(F.col(f"k{i}"), o.descending, o.nulls_first) for i, o in enumerate(order)]
    keys = [tuple(r) for r in _sorted(_keys(rest, order), ordered).limit(offset - start + 1).collect()]
    return keys[-1], len(keys) - 1 - keys.index(keys[-1])


def _is(order: Sequence[Order], key: Sequence[Any]) -> Column:
    out = F.lit(True)
    for o, value in zip(order, key, strict=True):
        out = out & o.column.eqNullSafe(F.lit(value))
    return out


def page_of(df: DataFrame, order: Sequence[Order], page: int, size: int) -> DataFrame:
    """One page of the ordered table; pages count from 1."""
    offset = (page - 1) * size
    if offset + size <= RANGE:
        return _sorted(df, order).offset(offset).limit(size) if offset else _sorted(df, order).limit(size)
    key, behind = first_key(df, order, offset)
    if key is None:
        return df.limit(0)
    found = _sorted(df.where(~before(order, key)), order)
    return found.offset(behind).limit(size) if behind else found.limit(size)


def page_after(df: DataFrame, order: Sequence[Order], key: Sequence[Any], size: int) -> DataFrame:
    """The rows behind a key: the next page of one that ends with it, if keys are of single rows."""
    return _sorted(df.where(~before(order, key) & ~_is(order, key)), order).limit(size)
