"""Looking at rows: search, sort, pages, first and last rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_float, ref, value_of
from .pages import Order, page_after, page_of

PREVIEW_ROWS = 100


def filter_any(df: DataFrame, pattern: str) -> DataFrame:
    """Rows in which some cell's text matches the regular expression, ignoring case."""
    tests = [F.coalesce(value_of(df, c).cast("string").rlike(f"(?i){pattern}"), F.lit(False)) for c in df.columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def row_order(df: DataFrame, sort: str | None, order_by: Sequence[str] = ()) -> list[Order]:
    """``column:asc|desc`` with missing values last either way, then the tie-break keys.

    A column that does not exist is ignored.
    """
    order = []
    if sort:
        name, _, direction = sort.partition(":")
        if name in df.columns:
            order.append(Order(value_of(df, name), direction.lower() == "desc", nulls_first=False))
    return order + [Order(ref(c)) for c in order_by]


def sort_order(df: DataFrame, sort: str | None, order_by: Sequence[str] = ()) -> list[Column]:
    return [o.sorted() for o in row_order(df, sort, order_by)]


def sort_by(df: DataFrame, sort: str | None, order_by: Sequence[str] = ()) -> DataFrame:
    order = sort_order(df, sort, order_by)
    return df.orderBy(*order) if order else df


def page(df: DataFrame, page: int, size: int, order_by: Sequence[str], sort: str | None = None) -> DataFrame:
    """One page of the ordered table; pages count from 1.

    Pages far back are found by counting, not by ordering what lies before them.
    """
    return page_of(df, row_order(df, sort, order_by), page, size)


def next_page(df: DataFrame, last: Sequence, size: int, order_by: Sequence[str], sort: str | None = None) -> DataFrame:
    """The page behind one whose last row has these values of the sort column, if there is one, and of ``order_by``."""
    return page_after(df, row_order(df, sort, order_by), last, size)


def page_totals(df: DataFrame) -> DataFrame:
    """Row and column totals that go with a page."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns")
    )


def head(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str] = (), sort: str | None = None) -> DataFrame:
    order = sort_order(df, sort, order_by)
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def tail(df: DataFrame, n: int = PREVIEW_ROWS, order_by: Sequence[str] = (), sort: str | None = None) -> DataFrame:
    """The last ``n`` rows in order: the first ``n`` of the reverse order, turned round."""
    reverse = []
    if sort:
        name, _, direction = sort.partition(":")
        if name in df.columns:
            c = value_of(df, name)
            reverse.append(c.asc_nulls_first() if direction.lower() == "desc" else c.desc_nulls_first())
    reverse += [ref(c).desc() for c in order_by]
    return df.orderBy(*reverse).limit(n).orderBy(*sort_order(df, sort, order_by))


def _finite(c: Column, dtype: T.DataType) -> Column:
    if is_float(dtype):
        return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[_finite(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), inner)
    return c


def sanitize_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, inside nested values too."""
    return df.select(*[_finite(ref(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
