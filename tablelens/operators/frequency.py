"""Value frequencies of many columns from one shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_float, is_numeric, is_text, missing_in_row, ref, value_of
from ..functions.text import equality_key


def literal_rows(spark: SparkSession, rows: Sequence[dict], schema: str) -> DataFrame:
    """A table of a few constants (column names, rule settings), made in the plan."""
    if not rows:
        return spark.createDataFrame([], schema)
    types = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [F.struct(*[F.lit(r[n]).cast(t).alias(n) for n, t in types]) for r in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def column_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [{"position": df.columns.index(c), "column": c} for c in columns]
    return literal_rows(df.sparkSession, rows, "position int, column string")


def melt(df: DataFrame, columns: Sequence[str], ids: Sequence[Column] = ()) -> DataFrame:
    """Rows ``(ids, column, value)`` with values as text; missing stays null."""
    cells = []
    for c in columns:
        value = value_of(df, c)
        if is_float(df.schema[c].dataType):
            value = value + F.lit(0.0)  # no negative zero
        cells.append(value.cast("string").alias(c))
    id_names = [f"__id_{i}" for i in range(len(ids))]
    flat = df.select(*[e.alias(n) for e, n in zip(ids, id_names)], *cells)
    return flat.unpivot(id_names, [ref(c) for c in columns], "column", "value")


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value, count)``; the missing cells of a column form a null value."""
    return melt(df, columns).groupBy("column", "value").count()


# Fields in which cells of different types are counted without turning numbers into text.
KINDS = {"whole": "bigint", "real": "double", "text": "string"}


def _typed_cell(df: DataFrame, name: str, compact: bool) -> tuple[str, Column]:
    c, t = value_of(df, name), df.schema[name].dataType
    if isinstance(t, T.IntegralType):
        return "whole", c.cast("bigint")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "whole", F.unix_micros(c.cast("timestamp"))
    if isinstance(t, T.DateType):
        return "whole", F.unix_date(c).cast("bigint")
    if is_float(t):
        return "real", c.cast("double") + F.lit(0.0)  # no negative zero
    return "text", equality_key(c) if compact and is_text(t) else c.cast("string")


def typed_frequencies(df: DataFrame, columns: Sequence[str], compact: bool = False) -> DataFrame:
    """Rows ``(position, whole, real, text, count)``: a cell fills the field of its type, if present.

    One shuffle of pre-aggregated values serves all columns.  ``compact``
    replaces long texts by digests where only equality matters.
    """
    cells = {c: _typed_cell(df, c, compact) for c in columns}
    kinds = [k for k in KINDS if any(kind == k for kind, _ in cells.values())]
    flat = df.select(*[expr.alias(f"c{i}") for i, (_, expr) in enumerate(cells.values())])
    parts: list[Column] = [F.lit(len(columns))]
    for i, (name, (kind, _)) in enumerate(cells.items()):
        parts.append(F.lit(df.columns.index(name)))
        parts += [F.col(f"c{i}") if k == kind else F.lit(None).cast(KINDS[k]) for k in kinds]
    return flat.select(F.stack(*parts).alias("position", *kinds)).groupBy("position", *kinds).count()


def _per_position(df: DataFrame, columns: Sequence[str], counted: DataFrame) -> DataFrame:
    """Attach the column names; columns of an empty table get a row too."""
    return column_list(df, columns).join(counted, "position", "left")


def _present(freq: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNotNull() for k in KINDS if k in freq.columns])


def distinct_counts(df: DataFrame, columns: Sequence[str], rows: bool = False) -> DataFrame:
    """``(position, column, unique_count)``, also for empty and all-missing columns.

    Several ``count(distinct)`` in one aggregation would expand every row per
    column without reducing it first.  ``rows`` adds the number of rows.
    """
    freq = typed_frequencies(df, columns, compact=True)
    counted = freq.groupBy("position").agg(
        F.count_if(_present(freq)).alias("unique_count"), F.sum("count").alias("rows")
    )
    wanted = ("unique_count", "rows") if rows else ("unique_count",)
    return _per_position(df, columns, counted).select(
        "position", "column", *[F.coalesce(n, F.lit(0)).alias(n) for n in wanted]
    )


def most_frequent(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value.

    The rank filter is applied per task before the final exchange
    (``WindowGroupLimit``), so at most ``k`` values per task and column move.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        frequencies(df, columns)
        .where(F.col("value").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def value_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(position, column, rows, unique_count, top_value, mode)`` from one shuffle of frequencies.

    ``top_value`` is the most frequent text, ``mode`` the most frequent number
    (dates have neither); the smaller one on ties.
    """
    freq = typed_frequencies(df, columns)
    numbers = [df.columns.index(c) for c in columns if is_numeric(df.schema[c].dataType)]

    def most(value: Column) -> Column:
        return F.min(F.when(value.isNotNull(), F.struct((-F.col("count")).alias("n"), value.alias("v"))))

    nothing = F.lit(None)
    text = F.col("text") if "text" in freq.columns else nothing.cast("string")
    # Decimals are counted as text, to lose no digit.
    fields = [F.col(k).try_cast("double") for k in KINDS if k in freq.columns]
    number = F.when(F.col("position").isin(numbers), F.coalesce(*fields)) if numbers else nothing.cast("double")
    found = freq.groupBy("position").agg(
        F.sum("count").alias("rows"),
        F.count_if(_present(freq)).alias("unique_count"),
        most(text).alias("top"),
        most(number).alias("mode"),
    )
    return _per_position(df, columns, found).select(
        "position",
        "column",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.col("top.v").alias("top_value"),
        F.col("mode.v").alias("mode"),
    )


# Rows estimated to be wider than this are grouped by digest.
WIDE_ROW = 256


def _width(dtype: T.DataType) -> int:
    if _nested(dtype):
        return WIDE_ROW + 1
    return 8 if isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) else 24


def row_keys(cells: Sequence[tuple[Column, T.DataType]]) -> list[Column]:
    """Grouping columns under which two rows are equal exactly when all cells are.

    Narrow rows are grouped by their cells.  Wide rows move as the SHA-256
    digest of their cells, each written with its length so that no two
    different rows have the same text.
    """
    if sum(_width(t) for _, t in cells) <= WIDE_ROW:
        return [(equality_key(c) if is_text(t) else c).alias(f"k{i}") for i, (c, t) in enumerate(cells)]
    parts = []
    for c, t in cells:
        # Adding zero makes negative zero equal to zero, as grouping does.
        text = (c + F.lit(0.0) if is_float(t) else c).cast("string") if not _nested(t) else F.to_json(F.struct(c))
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return [F.unhex(F.sha2(F.concat_ws("|", *parts), 256)).alias("k0")]


def _nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def row_groups(df: DataFrame) -> DataFrame:
    """One row per distinct row, with its number of copies and missing cells.

    Copies are collapsed before the shuffle.
    """
    keys = row_keys([(value_of(df, f.name), f.dataType) for f in df.schema.fields])
    flat = df.select(*keys, missing_in_row(df).alias("missing"))
    return flat.groupBy(*flat.columns).count()
