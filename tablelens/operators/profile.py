"""Data-quality profile of a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..functions.columns import (
    is_datetime,
    is_missing,
    is_numeric,
    is_text,
    numeric_columns,
    per_column,
    ref,
    require_columns,
    text_columns,
    value_of,
)
from ..functions.dates import has_shape, iso_text, parse_date
from .frequency import distinct_counts, literal_rows, melt, row_groups
from .quantiles import quantiles

# A text column is categorical below this many distinct values
# or below this share of distinct values.
CATEGORY_COUNT = 20
CATEGORY_SHARE = 0.05

# Rows in which sample values are looked for first.
OPENING_ROWS = 1000
# Text columns that one scan judges as dates.
DATE_BATCH = 50


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows, from one shuffle."""
    groups = row_groups(df)
    return groups.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("missing") * F.col("count")), F.lit(0)).alias("missing_cells"),
        (F.coalesce(F.sum("count"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def with_quality(profile: DataFrame, w_missing: float = stats.MISSING_WEIGHT, w_dup: float = stats.DUPLICATE_WEIGHT) -> DataFrame:
    score = stats.quality(
        F.col("rows"), F.col("rows") * F.col("columns"), F.col("missing_cells"), F.col("duplicate_rows"), w_missing, w_dup
    )
    return profile.withColumn("quality_score", score)


def quality_score(df: DataFrame, w_missing: float = stats.MISSING_WEIGHT, w_dup: float = stats.DUPLICATE_WEIGHT) -> DataFrame:
    """Table totals with the quality score."""
    return with_quality(table_profile(df), w_missing, w_dup)


def _cell_bytes(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(ref(name)), F.lit(0)).cast("bigint")
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(dtype, T.ArrayType):
        item = widths.get(type(dtype.elementType), 8)
        return F.greatest(F.size(ref(name)), F.lit(0)).cast("bigint") * item
    return F.lit(widths.get(type(dtype), 8)).cast("bigint")


def data_bytes(df: DataFrame) -> Column:
    """Aggregate: bytes of the data itself, text lengths plus fixed widths."""
    total = F.lit(0).cast("bigint")
    for name in df.columns:
        total = total + _cell_bytes(df, name)
    return F.coalesce(F.sum(total), F.lit(0))


def size_estimate(df: DataFrame) -> DataFrame:
    """Rows and bytes of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows"), data_bytes(df).alias("data_bytes"))


def missing_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column (0 % for an empty table)."""
    return per_column(
        df,
        list(columns or df.columns),
        lambda c: {"missing_count": F.count_if(is_missing(df, c)), "rows": F.count(F.lit(1))},
        finish=lambda m: {
            "missing_count": m["missing_count"],
            "missing_pct": stats.percent(m["missing_count"], m["rows"]),
        },
    )


def unique_by_column(df: DataFrame, exact: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct non-missing values per column."""
    columns = list(columns or df.columns)
    if exact:
        return distinct_counts(df, columns)
    return per_column(df, columns, lambda c: {"unique_count": F.approx_count_distinct(value_of(df, c))})


def date_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Date columns, and text columns with values of which all parse.

    A first scan counts the cells that have the shape of a date; only columns
    in which all have are parsed by a second one.  Two numbers per text column
    reach the driver.
    """
    names = list(candidates if candidates is not None else df.columns)
    found = {n for n in names if is_datetime(df.schema[n].dataType)}
    texts = [n for n in names if is_text(df.schema[n].dataType)]
    shaped = _columns_where_all(df, texts, has_shape)
    found |= set(_columns_where_all(df, shaped, lambda c: parse_date(c).isNotNull()))
    return [n for n in names if n in found]


def _columns_where_all(df: DataFrame, names: Sequence[str], test: Callable[[Column], Column]) -> list[str]:
    """The columns with values, all of which pass the test."""
    passed = []
    for start in range(0, len(names), DATE_BATCH):
        batch = names[start : start + DATE_BATCH]
        counts = []
        for i, n in enumerate(batch):
            counts += [F.count(ref(n)).alias(f"n{i}"), F.count_if(test(ref(n))).alias(f"good{i}")]
        row = df.agg(*counts).first()
        passed += [n for i, n in enumerate(batch) if 0 < row[f"n{i}"] == row[f"good{i}"]]
    return passed


def _fixed_types(df: DataFrame, dates: Sequence[str]) -> dict[str, str]:
    """Semantic types that do not depend on the number of distinct values."""
    fixed: dict[str, str] = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            fixed[f.name] = "boolean"
        elif is_numeric(f.dataType):
            fixed[f.name] = "numeric"
        elif f.name in dates:
            fixed[f.name] = "datetime"
    return fixed


def _category_or_text(unique: Column, rows: Column) -> Column:
    few = (unique < CATEGORY_COUNT) | F.coalesce(F.try_divide(unique, rows) < CATEGORY_SHARE, F.lit(False))
    return F.when(few, "categorical").otherwise("text")


def semantic_types(df: DataFrame) -> DataFrame:
    """boolean / numeric / datetime / categorical / text per column."""
    fixed = _fixed_types(df, date_columns(df))
    schema = "position int, column string, dtype string"
    known = [{"position": df.columns.index(n), "column": n, "dtype": t} for n, t in fixed.items()]
    out = literal_rows(df.sparkSession, known, schema)
    open_ = [c for c in df.columns if c not in fixed]
    if not open_:
        return out
    judged = distinct_counts(df, open_, rows=True).select(
        "position", "column", _category_or_text(F.col("unique_count"), F.col("rows")).alias("dtype")
    )
    return out.unionByName(judged) if known else judged


def _first_values(df: DataFrame, n: int, order_by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    ids = [ref(c) for c in order_by]
    cells = melt(df, columns, ids=ids).where(F.col("value").isNotNull())
    place = F.struct(*[F.col(f"__id_{i}") for i in range(len(ids))], F.col("value"))
    firsts = cells.groupBy("column", "value").agg(F.min(place).alias("place"))
    order = Window.partitionBy("column").orderBy("place")
    return (
        firsts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("column", F.col("rank").cast("bigint").alias("rank"), "value")
    )


def sample_values(
    df: DataFrame, n: int = 5, order_by: Sequence[str] = (), columns: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` distinct non-missing values per column in row order, as text.

    Values of rows with equal keys come in their own order, as do all values
    without ``order_by``.  Columns that show ``n`` values within the first rows,
    taken up to the end of the last key, are done with those.  Only the others,
    with few distinct or many missing values, are grouped over the whole table,
    where their few values collapse before the shuffle.
    """
    require_columns(df, order_by)
    columns = list(columns or df.columns)
    needed = df.select(*dict.fromkeys([*order_by, *columns]))
    if not order_by:
        return _first_values(needed, n, order_by, columns)
    keys = [ref(c) for c in order_by]
    last = needed.select(*keys).orderBy(*keys).limit(OPENING_ROWS).agg(F.max(F.struct(*keys)))
    opening = needed.where(F.struct(*keys) <= last.scalar())
    row = opening.agg(*[F.count_distinct(value_of(needed, c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    early = [c for c, found in zip(columns, row) if found >= n]
    late = [c for c in columns if c not in early]
    parts = [_first_values(t, n, order_by, cs) for t, cs in ((opening, early), (needed, late)) if cs]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Mean, median, minimum, maximum and sample deviation of numeric columns."""
    columns = list(columns or numeric_columns(df))
    medians = quantiles(df, columns, [0.5], exact)

    def measures(c: str) -> dict[str, Column]:
        x = value_of(df, c).cast("double")
        return {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_samp(x)}

    out = per_column(
        df,
        columns,
        measures,
        constants=lambda c: {"median": F.lit(medians[c][0.5]).cast("double")},
        schema="mean double, min double, max double, std double, median double",
    )
    return out.select("position", "column", "mean", "median", "min", "max", "std")


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Average and maximum text length; missing cells have no length."""
    columns = list(columns or text_columns(df))
    return per_column(
        df,
        columns,
        lambda c: {
            "avg_length": F.coalesce(F.avg(F.length(ref(c))), F.lit(0.0)),
            "max_length": F.coalesce(F.max(F.length(ref(c))), F.lit(0)).cast("bigint"),
        },
        schema="avg_length double, max_length bigint",
    )


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last date per date column, as ISO text; unparsable cells are skipped."""
    columns = list(columns or date_columns(df))
    return per_column(
        df,
        columns,
        lambda c: {"min_date": F.min(as_timestamp(df, c)), "max_date": F.max(as_timestamp(df, c))},
        finish=lambda m: {"min_date": iso_text(m["min_date"]), "max_date": iso_text(m["max_date"])},
        schema="min_date string, max_date string",
    )


def as_timestamp(df: DataFrame, name: str) -> Column:
    if is_text(df.schema[name].dataType):
        return parse_date(ref(name))
    return ref(name).cast("timestamp")


def column_profile(
    df: DataFrame,
    exact: bool = True,
    quarts: dict | None = None,
    dates: Sequence[str] | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """All per-column measures side by side.

    One scan with a wide aggregation, one shuffle of value frequencies, and the
    passes for the medians; ``quarts`` and ``values`` are the quartiles and the
    value summary if they are known already.
    """
    dates = list(date_columns(df) if dates is None else dates)
    fixed = _fixed_types(df, dates)
    numbers = numeric_columns(df)
    if quarts is None:
        quarts = quantiles(df, numbers, [0.5], exact)
    nothing, no_date = F.lit(None).cast("double"), F.lit(None).cast("timestamp")

    def measures(c: str) -> dict[str, Column]:
        number = value_of(df, c).cast("double") if c in numbers else None
        length = F.length(ref(c)) if is_text(df.schema[c].dataType) and c not in dates else None
        date = as_timestamp(df, c) if c in dates else None
        out = {"rows": F.count(F.lit(1)), "missing_count": F.count_if(is_missing(df, c))}
        for name, fn in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp)):
            out[name] = nothing if number is None else fn(number)
        out["avg_length"] = nothing if length is None else F.coalesce(F.avg(length), F.lit(0.0))
        out["max_length"] = (nothing if length is None else F.coalesce(F.max(length), F.lit(0))).cast("bigint")
        out["min_date"] = no_date if date is None else F.min(date)
        out["max_date"] = no_date if date is None else F.max(date)
        return out

    measured = per_column(
        df,
        df.columns,
        measures,
        constants=lambda c: {
            "median": F.lit(quarts[c][0.5] if c in numbers else None).cast("double"),
            "fixed": F.lit(fixed.get(c)).cast("string"),
        },
    )
    unique = unique_by_column(df, exact) if values is None else values
    unique = unique.select("position", "unique_count")
    dtype = F.coalesce("fixed", _category_or_text(F.col("unique_count"), F.col("rows")))
    return measured.join(unique, "position").select(
        "position",
        "column",
        dtype.alias("dtype"),
        "missing_count",
        stats.percent(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        "unique_count",
        "mean",
        "median",
        "min",
        "max",
        "std",
        "avg_length",
        "max_length",
        iso_text(F.col("min_date")).alias("min_date"),
        iso_text(F.col("max_date")).alias("max_date"),
    )
