"""Exploratory statistics of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import (
    is_datetime,
    is_numeric,
    missing_in_row,
    numeric_columns,
    per_column,
    ref,
    require_columns,
    value_of,
)
from ..functions.dates import iso_text, whole_days
from .comoments import coefficients
from .frequency import literal_rows, most_frequent, value_summary
from .hash_order import mark_first
from .profile import as_timestamp, date_columns, missing_by_column, table_profile, with_quality
from .quantiles import quantiles

# Fixed values of the statistics.
SAMPLE_ROWS = 100_000
SAMPLE_SEED = 42
HISTOGRAM_BINS = 20
CORRELATION_THRESHOLD = 0.3
TOP_VALUES = 20
SKEW_LIMIT = 1.0
FENCE = 1.5

QUARTILES = (0.25, 0.5, 0.75)
PAIRS_PER_SCAN = 100


def sample_exact(df: DataFrame, n: int = SAMPLE_ROWS, key: Sequence[str] = (), seed: int = SAMPLE_SEED) -> DataFrame:
    """A repeatable sample of exactly ``n`` rows, or all rows if there are fewer.

    Rows are taken in the order of a hash of their key, up to a limit that
    bucket counts give; rows beyond it never leave their task.
    """
    names = list(key or df.columns)
    require_columns(df, names)
    quota = df.agg(F.lit(0).alias("q"), F.least(F.count(F.lit(1)), F.lit(n)).alias("quota"))
    return mark_first(df, quota, "__sampled", names, seed).where("__sampled").drop("__sampled")


def overview(df: DataFrame) -> DataFrame:
    """Table totals with quality; all rows are used, so nothing is marked as sampled."""
    return with_quality(table_profile(df)).select(
        "*", F.lit(False).alias("is_sampled"), F.col("rows").alias("sample_rows")
    )


def classify_columns(df: DataFrame) -> DataFrame:
    """numeric / datetime / categorical per column; booleans are categorical."""
    dates = set(date_columns(df))
    rows = []
    for i, f in enumerate(df.schema.fields):
        kind = "numeric" if is_numeric(f.dataType) else "datetime" if f.name in dates else "categorical"
        rows.append({"position": i, "column": f.name, "kind": kind})
    return literal_rows(df.sparkSession, rows, "position int, column string, kind string")


def categorical_columns(df: DataFrame) -> list[str]:
    open_ = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and not is_datetime(f.dataType)]
    dates = set(date_columns(df, open_))
    return [c for c in open_ if c not in dates]


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    quarts: dict | None = None,
    values: DataFrame | None = None,
) -> DataFrame:
    """Moments, quartiles and mode of numeric columns; columns without values are left out.

    ``quarts`` and ``values`` are the quartiles and the value summary if they
    are known already.
    """
    columns = list(columns or numeric_columns(df))
    require_columns(df, columns)
    if quarts is None:
        quarts = quantiles(df, columns, QUARTILES, exact)
    columns = [c for c in columns if quarts[c][0.5] is not None]

    def measures(c: str) -> dict[str, Column]:
        x = value_of(df, c).cast("double")
        return {
            "count": F.count(x),
            "mean": F.avg(x),
            "variance": F.var_samp(x),
            "min": F.min(x),
            "max": F.max(x),
            "skewness": stats.skewness_adj(x),
            "kurtosis": stats.kurtosis_adj(x),
        }

    def constants(c: str) -> dict[str, Column]:
        q = quarts[c]
        return {
            "q25": F.lit(q[0.25]),
            "median": F.lit(q[0.5]),
            "q75": F.lit(q[0.75]),
            "iqr": F.lit(q[0.75] - q[0.25]),
        }

    names = ["count bigint"] + [
        f"{n} double"
        for n in ("mean", "std", "variance", "min", "max", "skewness", "kurtosis", "q25", "median", "q75", "iqr")
    ]
    moments = per_column(
        df, columns, measures, constants, finish=lambda m: {**m, "std": F.sqrt(m["variance"])}, schema=", ".join(names)
    )
    if not columns:
        return moments.withColumn("mode", F.lit(None).cast("double"))
    if values is None:
        values = value_summary(df, columns)
    return moments.join(values.select("column", "mode"), "column", "left")


def shape_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Corrected skewness and excess kurtosis per numeric column."""
    columns = list(columns or numeric_columns(df))
    return per_column(
        df,
        columns,
        lambda c: {
            "skewness": stats.skewness_adj(value_of(df, c).cast("double")),
            "kurtosis": stats.kurtosis_adj(value_of(df, c).cast("double")),
        },
        schema="skewness double, kurtosis double",
    )


def skew_flag(statistics: DataFrame, limit: float = SKEW_LIMIT) -> DataFrame:
    """Mark columns whose skewness exceeds the limit in size."""
    return statistics.withColumn("is_skewed", F.coalesce(F.abs("skewness") > limit, F.lit(False)))


# Bins of values below and above all finite ones.
BELOW, ABOVE = -1, 1_000_000


def histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins of the finite values of numeric columns with their edges and counts, empty bins included.

    One scan finds the ends of all columns, a second one counts the bins of all.
    The last bin is closed on the right; a constant column gets a range of one
    around its value, a column without finite values no bins.  Infinities are
    counted apart, in the bins ``BELOW`` and ``ABOVE`` where there are any.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    require_columns(df, columns)
    spark, schema = df.sparkSession, "position int, column string, bin int, lower double, upper double, count bigint"
    if not columns:
        return spark.createDataFrame([], schema)
    endless = F.lit(float("inf"))
    flat = df.select(*[value_of(df, c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    finite = [F.when(F.abs(v) < endless, F.col(v)) for v in flat.columns]
    ends = flat.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(finite) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {}
    for i in range(len(columns)):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is not None:
            lo, hi = (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)
            # The difference of the ends may be beyond a double.
            ranges[i] = (lo, hi, (hi - lo) / bins if math.isfinite(hi - lo) else hi / bins - lo / bins)
    cells = []
    for i, v in enumerate(flat.columns):
        c = F.col(v)
        place = F.when(c == endless, ABOVE).when(c == -endless, BELOW)
        if i in ranges:
            lo, hi, width = ranges[i]
            at = (c - F.lit(lo)) / F.lit(width) if math.isfinite(hi - lo) else c / F.lit(width) - F.lit(lo / width)
            place = place.when(c.isNotNull(), F.least(F.floor(at), F.lit(bins - 1)))
        cells.append(F.struct(F.lit(i).alias("i"), place.cast("int").alias("bin")))
    counted = flat.select(F.inline(F.array(*cells))).where(F.col("bin").isNotNull()).groupBy("i", "bin").agg(F.count(F.lit(1)).alias("count"))
    known = [
        {"i": i, "bin": b, "lower": lo + b * width, "upper": hi if b == bins - 1 else lo + (b + 1) * width}
        for i, (lo, hi, width) in ranges.items()
        for b in range(bins)
    ]
    known += [{"i": i, "bin": b, "lower": e, "upper": e} for i in range(len(columns)) for b, e in ((BELOW, -float("inf")), (ABOVE, float("inf")))]
    edges = spark.createDataFrame([tuple(r.values()) for r in known], "i int, bin int, lower double, upper double")
    name, position = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(df.columns.index(c)) for c in columns])
    # A row per column and bin.
    return edges.join(counted, ["i", "bin"], "left").where(F.col("count").isNotNull() | (F.col("bin").between(0, bins - 1))).select(
        position[F.col("i")].alias("position"), name[F.col("i")].alias("column"), "bin", "lower", "upper", F.coalesce("count", F.lit(0)).alias("count")
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """The bins of one column, as in ``histograms``."""
    return histograms(df, [column], bins).drop("position", "column")


def outlier_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    k: float = FENCE,
    exact: bool = True,
    quarts: dict | None = None,
) -> DataFrame:
    """Fences, outlier count and percentage of the present values per numeric column."""
    columns = list(columns or numeric_columns(df))
    if quarts is None:
        quarts = quantiles(df, columns, (0.25, 0.75), exact)
    columns = [c for c in columns if quarts[c][0.25] is not None]
    fences = {}
    for c in columns:
        spread = quarts[c][0.75] - quarts[c][0.25]
        fences[c] = (quarts[c][0.25] - k * spread, quarts[c][0.75] + k * spread)

    def measures(c: str) -> dict[str, Column]:
        x = value_of(df, c)
        return {"n": F.count(x), "outlier_count": F.count_if((x < fences[c][0]) | (x > fences[c][1]))}

    out = per_column(
        df,
        columns,
        measures,
        constants=lambda c: {"lower_bound": F.lit(fences[c][0]), "upper_bound": F.lit(fences[c][1])},
        finish=lambda m: {
            "outlier_count": m["outlier_count"],
            "outlier_pct": stats.percent(m["outlier_count"], m["n"]),
        },
        schema="outlier_count bigint, outlier_pct double, lower_bound double, upper_bound double",
    )
    return out


def describe_categorical(
    df: DataFrame, columns: Sequence[str] | None = None, values: DataFrame | None = None
) -> DataFrame:
    """Distinct count, distinct share of all rows, and the most frequent value."""
    columns = list(columns if columns is not None else categorical_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, unique_count bigint, cardinality_ratio double, top_value string"
        )
    if values is None:
        values = value_summary(df, columns)
    return values.where(F.col("column").isin(columns)).select(
        "position",
        "column",
        "unique_count",
        F.coalesce(F.try_divide("unique_count", "rows"), F.lit(0.0)).alias("cardinality_ratio"),
        "top_value",
    )


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values per categorical column."""
    columns = list(columns if columns is not None else categorical_columns(df))
    return most_frequent(df, columns, k).select(
        "column", F.col("rank").cast("bigint").alias("rank"), "value", "count"
    )


def describe_datetime(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Earliest and latest date and the span in whole elapsed days."""
    columns = list(columns if columns is not None else date_columns(df))
    return per_column(
        df,
        columns,
        lambda c: {"first": F.min(as_timestamp(df, c)), "last": F.max(as_timestamp(df, c))},
        finish=lambda m: {
            "earliest_date": iso_text(m["first"]),
            "latest_date": iso_text(m["last"]),
            "span_days": whole_days(m["first"], m["last"]).cast("double"),
        },
        schema="earliest_date string, latest_date string, span_days double",
    ).where(F.col("earliest_date").isNotNull())


def correlations(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = CORRELATION_THRESHOLD
) -> DataFrame:
    """Pearson coefficients of column pairs in column order, from ``threshold`` up; undefined ones are left out.

    Few pairs are aggregated in one scan; of many, co-moments are summed up in
    blocks, whose number of scans does not grow with the pairs.
    """
    columns = list(columns or numeric_columns(df))
    require_columns(df, columns)
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)] if k * (k - 1) // 2 <= PAIRS_PER_SCAN else None
    schema = "pair int, column1 string, column2 string, coefficient double"
    if pairs == []:
        return df.sparkSession.createDataFrame([], schema)
    found = _pairwise(df, columns, pairs) if pairs else coefficients(df, columns)
    name = F.array(*[F.lit(c) for c in columns])
    i, j = F.col("i"), F.col("j")
    number = i * k - F.expr("i * (i + 1) div 2").cast("int") + (j - i - 1)
    return found.where((F.abs("coefficient") >= threshold) & ~F.isnan("coefficient")).select(
        number.cast("int").alias("pair"), name[i].alias("column1"), name[j].alias("column2"), "coefficient"
    )


def _pairwise(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    number = lambda c: value_of(df, c).cast("double")
    wide = df.agg(*[stats.pearson(number(columns[i]), number(columns[j])).alias(f"r{n}") for n, (i, j) in enumerate(pairs)])
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{n}").alias("coefficient")) for n, (i, j) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Symmetric matrix with unit diagonal; cells below the threshold are null."""
    ones = literal_rows(
        pairs.sparkSession,
        [{"row": c, "col": c, "coefficient": 1.0} for c in columns],
        "row string, col string, coefficient double",
    )
    up = pairs.select(F.col("column1").alias("row"), F.col("column2").alias("col"), "coefficient")
    down = pairs.select(F.col("column2").alias("row"), F.col("column1").alias("col"), "coefficient")
    return up.unionByName(down).unionByName(ones).groupBy("row").pivot("col", list(columns)).agg(F.max("coefficient"))


def missing_row_distribution(df: DataFrame) -> DataFrame:
    """How many rows have how many missing cells."""
    return df.groupBy(missing_in_row(df).alias("missing_cells")).agg(F.count(F.lit(1)).alias("rows"))
