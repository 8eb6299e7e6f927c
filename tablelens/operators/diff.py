"""Comparison of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats
from ..functions.columns import is_datetime, is_numeric, is_text, missing_in_row, ref, value_of
from .frequency import literal_rows, row_keys


def _kind(dtype: T.DataType) -> str:
    if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
        return "number"
    if is_datetime(dtype):
        return "date"
    return "text" if is_text(dtype) else dtype.simpleString()


def _shared(df: DataFrame, name: str, other: T.DataType, null_as_empty: bool) -> Column:
    """The cell in a form in which equal values of both versions are equal."""
    dtype = df.schema[name].dataType
    c = value_of(df, name)
    if _kind(dtype) != _kind(other):
        # Values of different kinds never match; only missing cells do.
        c = F.concat(F.lit(_kind(dtype) + ":"), c.cast("string"))
    elif dtype != other:
        c = c.cast("double") if _kind(dtype) == "number" else c.cast("timestamp" if _kind(dtype) == "date" else "string")
    elif isinstance(dtype, T.BooleanType):
        c = c.cast("double")
    if null_as_empty:
        empty = (c.cast("string") == "") if _kind(dtype) == "text" else F.lit(False)
        c = F.when(~F.coalesce(empty, F.lit(False)), c)
    return c


def comparable(v1: DataFrame, v2: DataFrame) -> bool:
    """Rows can only be equal when both versions have the same number of columns."""
    return len(v1.columns) == len(v2.columns)


def row_presence(v1: DataFrame, v2: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """One row per distinct row of either version with its copies and missing cells in each.

    Columns are matched by position.  One shuffle, with copies collapsed before
    it, answers added, removed, duplicate and total counts together.
    """
    sides = []
    for side, df, other in ((0, v1, v2), (1, v2, v1)):
        if comparable(v1, v2):
            cells = [
                _shared(df, n, other.schema.fields[i].dataType, null_as_empty) for i, n in enumerate(df.columns)
            ]
        else:
            # Never equal across versions: the side is part of the row.
            cells = [F.to_json(F.struct(F.lit(side).alias("side"), *[value_of(df, n).alias(n) for n in df.columns]))]
        types = [f.dataType for f in df.select(*cells).schema.fields]
        ones = [F.lit(1 - side).cast("bigint").alias("n1"), F.lit(side).cast("bigint").alias("n2")]
        sides.append(df.select(*row_keys(list(zip(cells, types))), missing_in_row(df).alias("missing"), *ones))
    both = sides[0].unionByName(sides[1])
    keys = [c for c in both.columns if c not in ("missing", "n1", "n2")]
    return both.groupBy(*keys).agg(
        F.sum("n1").alias("n1"),
        F.sum("n2").alias("n2"),
        F.sum(F.col("missing") * F.col("n1")).alias("missing1"),
        F.sum(F.col("missing") * F.col("n2")).alias("missing2"),
    )


def _metrics(v1: DataFrame, v2: DataFrame, null_as_empty: bool) -> DataFrame:
    found = row_presence(v1, v2, null_as_empty)
    zero = F.lit(0)
    return found.agg(
        *[
            e
            for i in (1, 2)
            for e in (
                F.coalesce(F.sum(f"n{i}"), zero).alias(f"v{i}_rows"),
                F.coalesce(F.sum(f"missing{i}"), zero).alias(f"v{i}_missing"),
                (F.coalesce(F.sum(f"n{i}"), zero) - F.count_if(F.col(f"n{i}") > 0)).alias(f"v{i}_duplicates"),
            )
        ],
        F.count_if((F.col("n1") == 0) & (F.col("n2") > 0)).alias("added_rows"),
        F.count_if((F.col("n1") > 0) & (F.col("n2") == 0)).alias("removed_rows"),
    )


def row_changes(v1: DataFrame, v2: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """Added, removed and changed row counts.

    ``changed_rows`` is the growth that distinct additions and removals do not
    explain, that is, a drift in the number of copies.
    """
    m = _metrics(v1, v2, null_as_empty)
    drift = F.col("v2_rows") - F.col("v1_rows") - F.col("added_rows") + F.col("removed_rows")
    return m.select("added_rows", "removed_rows", F.greatest(F.lit(0), drift).cast("bigint").alias("changed_rows"))



def diff_metrics(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicates and quality of both versions, and the differences."""
    m = _metrics(v1, v2, False)
    for i, df in ((1, v1), (2, v2)):
        m = m.withColumn(f"v{i}_columns", F.lit(len(df.columns)).cast("bigint"))
        m = m.withColumn(
            f"v{i}_quality",
            stats.quality(
                F.col(f"v{i}_rows"),
                F.col(f"v{i}_rows") * len(df.columns),
                F.col(f"v{i}_missing"),
                F.col(f"v{i}_duplicates"),
            ),
        )
    names = ("rows", "columns", "missing", "duplicates", "quality")
    return m.select(
        *[f"v{i}_{n}" for i in (1, 2) for n in names],
        *[(F.col(f"v2_{n}") - F.col(f"v1_{n}")).alias(f"{n}_difference") for n in names],
    )


def _one_side(keep: DataFrame, other: DataFrame, null_as_empty: bool) -> DataFrame:
    if not comparable(keep, other):
        return keep.distinct()
    kept = [
        _shared(keep, n, other.schema.fields[i].dataType, null_as_empty).alias(n) for i, n in enumerate(keep.columns)
    ]
    gone = [
        _shared(other, n, keep.schema.fields[i].dataType, null_as_empty).alias(keep.columns[i])
        for i, n in enumerate(other.columns)
    ]
    here = keep.select(*kept, F.lit(1).alias("__here"), F.lit(0).alias("__there"))
    there = other.select(*gone, F.lit(0).alias("__here"), F.lit(1).alias("__there"))
    # Group rather than anti-join: copies of a row collapse before the shuffle.
    grouped = here.unionByName(there).groupBy(*[ref(c) for c in keep.columns]).agg(
        F.max("__here").alias("__here"), F.max("__there").alias("__there")
    )
    return grouped.where((F.col("__here") == 1) & (F.col("__there") == 0)).select(*[ref(c) for c in keep.columns])


def rows_added(v1: DataFrame, v2: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """Distinct rows of the second version that the first does not have."""
    return _one_side(v2, v1, null_as_empty)


def rows_removed(v1: DataFrame, v2: DataFrame, null_as_empty: bool = False) -> DataFrame:
    """Distinct rows of the first version that the second does not have."""
    return _one_side(v1, v2, null_as_empty)


def schema_table(df: DataFrame) -> DataFrame:
    rows = [{"column": f.name, "dtype": f.dataType.simpleString()} for f in df.schema.fields]
    return literal_rows(df.sparkSession, rows, "column string, dtype string")


def diff_columns(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Columns only one of the versions has."""
    s1, s2 = schema_table(v1), schema_table(v2)
    added = s2.join(s1, "column", "left_anti").select("column", F.lit("added").alias("change"))
    removed = s1.join(s2, "column", "left_anti").select("column", F.lit("removed").alias("change"))
    return added.unionByName(removed)


def diff_types(v1: DataFrame, v2: DataFrame) -> DataFrame:
    """Columns of both versions whose types differ."""
    s1 = schema_table(v1).withColumnRenamed("dtype", "v1_type")
    s2 = schema_table(v2).withColumnRenamed("dtype", "v2_type")
    return s1.join(s2, "column").where(F.col("v1_type") != F.col("v2_type"))


def lineage(jobs: DataFrame, version_id: str) -> DataFrame:
    """The cleaning steps that produced a version, in order."""
    return jobs.where(F.col("target_version_id") == version_id).select(
        "job_id", F.posexplode("cleaning_summary").alias("step", "op")
    ).select("job_id", "step", "op.*")


def diff_insights(ins1: DataFrame, ins2: DataFrame) -> DataFrame:
    """Finding categories that appeared or were resolved between two versions.

    Both inputs have an ``insights`` array with a ``category`` per finding.
    """
    sides = []
    for side, df in ((1, ins1), (2, ins2)):
        found = df.select(F.explode("insights").alias("i")).select(F.col("i.category").alias("category"))
        sides.append(found.select("category", F.lit(2 - side).alias("in1"), F.lit(side - 1).alias("in2")))
    merged = sides[0].unionByName(sides[1]).groupBy("category").agg(F.max("in1").alias("in1"), F.max("in2").alias("in2"))
    return merged.where(F.col("in1") != F.col("in2")).select(
        "category", F.when(F.col("in2") == 1, "new").otherwise("resolved").alias("change")
    )
