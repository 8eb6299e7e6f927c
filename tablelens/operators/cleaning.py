"""Cleaning operators, each ``(table, options) -> table``."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TableError
from ..functions.columns import is_datetime, is_missing, is_numeric, is_text, ref, require_columns, value_of
from ..functions.dates import DATE_LAYOUTS, parse_date
from ..functions.text import strip_space, title_case
from .ordering import fill_along
from .quantiles import quantiles

# Words read as true by a boolean cast.
TRUE_WORDS = ("true", "1", "yes", "t", "y")

FILL_STRATEGIES = ("mean", "median", "mode", "constant", "ffill", "bfill")
TEXT_STRATEGIES = ("trim", "lower", "upper", "title")
CAST_TARGETS = ("string", "numeric", "datetime", "boolean")
OUTLIER_STRATEGIES = ("iqr", "z_score")


def replace_column(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Replace one column in place, keeping the column order."""
    return df.select(*[expr.alias(c) if c == name else ref(c) for c in df.columns])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row per distinct row; missing cells are equal to each other, so NaN becomes null."""
    return df.select(*[value_of(df, c).alias(c) for c in df.columns]).dropDuplicates()


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    """Rows whose cell in ``column`` is present."""
    require_columns(df, [column])
    return df.where(~is_missing(df, column))


def _fill_with(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Fill with one value; a number widens a numeric column, any other value that does not fit turns it into text."""
    dtype = df.schema[column].dataType
    if is_numeric(dtype) and isinstance(value, float) and not value.is_integer():
        dtype = T.DoubleType()
    fits = is_text(dtype)
    if not fits and value != "":
        probe = df.sparkSession.range(1).select(F.lit(value).cast("string").try_cast(dtype).isNotNull()).first()
        fits = bool(probe[0])
    if fits:
        expr = F.coalesce(value_of(df, column).cast(dtype), F.lit(value).cast("string").cast(dtype))
    else:
        expr = F.coalesce(value_of(df, column).cast("string"), F.lit(str(value)))
    return replace_column(df, column, expr)


def most_common(df: DataFrame, column: str) -> Any:
    """The most frequent value, the smallest on ties; None without values."""
    counts = df.where(~is_missing(df, column)).groupBy(ref(column).alias("value")).count()
    row = counts.orderBy(F.desc("count"), F.asc("value")).first()
    return row["value"] if row else None


def fill_missing(
    df: DataFrame,
    column: str,
    strategy: str,
    fill_value: Any = None,
    order_by: Sequence[str] | None = None,
    partition_by: Sequence[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Fill the missing cells of one column.

    ``mean`` stays in the plan as a scalar subquery; ``median`` and ``mode``
    are found first and enter the plan as one constant.
    """
    require_columns(df, [column])
    if strategy in ("mean", "median") and not is_numeric(df.schema[column].dataType):
        raise TableError(f"{strategy} needs a numeric column, {column} is not")
    if strategy == "mean":
        mean = df.agg(F.avg(value_of(df, column).cast("double"))).scalar()
        return replace_column(df, column, F.coalesce(value_of(df, column).cast("double"), mean))
    if strategy == "median":
        median = quantiles(df, [column], [0.5], exact)[column][0.5]
        return replace_column(
            df, column, F.coalesce(value_of(df, column).cast("double"), F.lit(median).cast("double"))
        )
    if strategy == "mode":
        value = most_common(df, column)
        if value is None:
            return _fill_with(df, column, "")
        return replace_column(
            df, column, F.coalesce(value_of(df, column), F.lit(value).cast(df.schema[column].dataType))
        )
    if strategy == "constant":
        return _fill_with(df, column, "" if fill_value is None else fill_value)
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise TableError(f"{strategy} needs order_by: a table has no row order of its own")
        return fill_along(df, column, order_by, partition_by, forward=strategy == "ffill")
    raise TableError(f"unknown fill strategy: {strategy}")


def text_expr(c: Column, strategy: str) -> Column:
    if strategy == "trim":
        return strip_space(c)
    if strategy == "lower":
        return F.lower(c)
    if strategy == "upper":
        return F.upper(c)
    if strategy == "title":
        return title_case(c)
    raise TableError(f"unknown text strategy: {strategy}")


def clean_text(df: DataFrame, column: str, strategy: str) -> DataFrame:
    """Trim or change the case of a text column; missing stays missing."""
    require_columns(df, [column])
    if not is_text(df.schema[column].dataType):
        raise TableError(f"text operations need a text column, {column} is not")
    return replace_column(df, column, text_expr(ref(column), strategy))


def cast_expr(df: DataFrame, column: str, target: str, formats: Sequence[str] | None = None) -> Column:
    c, dtype = value_of(df, column), df.schema[column].dataType
    if target == "string":
        return c.cast("string")
    if target == "numeric":
        if is_numeric(dtype):
            return c
        if is_datetime(dtype):
            return c.cast("timestamp").cast("double")
        # Spark also reads the suffixes of its literals, as in 12D.
        number = F.when(~F.trim(c).rlike("[dDfF]$"), F.trim(c).try_cast("double")) if is_text(dtype) else c.cast("double")
        return number
    if target == "datetime":
        if is_text(dtype):
            return parse_date(c, formats or DATE_LAYOUTS)
        if isinstance(dtype, T.BooleanType):
            return F.lit(None).cast("timestamp")
        return c.cast("timestamp")
    if target == "boolean":
        if isinstance(dtype, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        return F.coalesce(F.lower(strip_space(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))
    raise TableError(f"unknown cast target: {target}")


def cast_type(df: DataFrame, column: str, target: str, formats: Sequence[str] | None = None) -> DataFrame:
    """Change a column's type; what cannot be read becomes missing (false for booleans)."""
    require_columns(df, [column])
    return replace_column(df, column, cast_expr(df, column, target, formats))


def changed(before: Column, after: Column) -> Column:
    """Whether a cell's text differs, missing being equal to missing."""
    return ~before.cast("string").eqNullSafe(after.cast("string"))


def affected_count(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Number of rows in which two versions of a cell differ."""
    return df.agg(F.count_if(changed(before, after)).alias("affected"))


def outlier_bounds(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> tuple[float, float] | None:
    """Tukey fences of a column, None without values."""
    q = quantiles(df, [column], [0.25, 0.75], exact)[column]
    if q[0.25] is None:
        return None
    spread = q[0.75] - q[0.25]
    return q[0.25] - k * spread, q[0.75] + k * spread


def outlier_test(
    df: DataFrame, column: str, strategy: str, k: float = 1.5, z: float = 3.0, exact: bool = True
) -> Column:
    """True for rows to drop; never true for a missing cell."""
    require_columns(df, [column])
    if not is_numeric(df.schema[column].dataType):
        raise TableError(f"outlier removal needs a numeric column, {column} is not")
    x = value_of(df, column)
    if strategy == "iqr":
        bounds = outlier_bounds(df, column, k, exact)
        if bounds is None:
            return F.lit(False)
        return F.coalesce((x < bounds[0]) | (x > bounds[1]), F.lit(False))
    if strategy == "z_score":
        moments = df.agg(
            F.struct(F.avg(x.cast("double")).alias("mean"), F.stddev_samp(x.cast("double")).alias("std"))
        ).scalar()
        score = F.abs(F.try_divide(x - moments["mean"], moments["std"]))
        return F.coalesce((moments["std"] > 0) & (score > z), F.lit(False))
    raise TableError(f"unknown outlier strategy: {strategy}")


def remove_outliers(
    df: DataFrame, column: str, strategy: str, k: float = 1.5, z: float = 3.0, exact: bool = True
) -> DataFrame:
    """Drop rows whose value lies outside the fences or beyond ``z`` deviations."""
    return df.where(~outlier_test(df, column, strategy, k, z, exact))
