"""Schema classes, missing values and per-column aggregate helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import TableError

COLUMNS_PER_SCAN = 40

FLOATS = (T.FloatType, T.DoubleType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOATS)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only: a boolean is not numeric here."""
    return isinstance(dtype, T.NumericType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise TableError(f"no such column: {', '.join(absent)}")


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_of(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = ref(name)
    if is_float(df.schema[name].dataType):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    c = ref(name)
    if is_float(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_in_row(df: DataFrame) -> Column:
    """Number of missing cells of a row."""
    total = F.lit(0).cast("bigint")
    for name in df.columns:
        total = total + is_missing(df, name).cast("bigint")
    return total


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]



def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: Callable[[str], dict[str, Column]],
    constants: Callable[[str], dict[str, Column]] | None = None,
    finish: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
    schema: str | None = None,
) -> DataFrame:
    """One output row per input column from a single aggregation.

    ``measures`` names the aggregates of a column.  All columns are reduced in
    the same scan, with partial aggregation before the one-row exchange; the
    wide result row is then turned into ``(position, column, ...)`` rows.
    ``finish`` derives the output fields from the aggregated ones.
    """
    if not columns:
        base = "position int, column string"
        return df.sparkSession.createDataFrame([], f"{base}, {schema}" if schema else base)
    parts = [
        _one_scan(df, columns[i : i + COLUMNS_PER_SCAN], measures, constants, finish)
        for i in range(0, len(columns), COLUMNS_PER_SCAN)
    ]
    return reduce(DataFrame.unionByName, parts)


def _one_scan(df, columns, measures, constants, finish) -> DataFrame:
    aggregates, rows = [], []
    for i, name in enumerate(columns):
        fields = measures(name)
        aggregates += [expr.alias(f"m{i}_{key}") for key, expr in fields.items()]
        reduced = {key: F.col(f"m{i}_{key}") for key in fields}
        out = finish(reduced) if finish else reduced
        if constants:
            out = {**out, **constants(name)}
        rows.append(
            F.struct(
                F.lit(df.columns.index(name)).alias("position"),
                F.lit(name).alias("column"),
                *[expr.alias(key) for key, expr in out.items()],
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
