import datetime

import pytest
from pyspark.sql import functions as F

from tablelens import TableError
from tablelens.operators import cleaning as op
from tablelens.plans import cleaning_run as run


def rows(df, order=None):
    return [tuple(r) for r in df.orderBy(order or df.columns[0]).collect()]


def test_sequence_by_hand(harvest):
    # Quartiles 45 and 49, so yields outside 39 to 55 are outliers; the median of the five that stay is 46.
    steps = [
        {"type": "clean_text", "column": "crop", "strategy": "trim"},
        {"type": "remove_outliers", "column": "kilos", "strategy": "iqr"},
        {"type": "drop_duplicates"},
        {"type": "fill_missing", "column": "kilos", "strategy": "median"},
    ]
    cleaned, summary = run.clean(harvest, steps)
    assert rows(cleaned) == [
        (10, "rye", 40.0), (11, "oat", 44.0), (12, "oat", 46.0), (13, "rye", 46.0), (14, "barley", 50.0), (16, "wheat", 48.0),
    ]
    assert [r["affected"] for r in summary.orderBy("step").collect()] == [2, 1, 1, 1]
    rolled = run.job_rollup(summary).first().asDict()
    assert rolled == {"rows_removed": 2, "duplicates_removed": 1, "missing_handled": 1, "outliers_handled": 1}


def test_null_in_duplicate(spark):
    df = spark.createDataFrame([("elm", None), ("ash", 6), ("elm", None), ("oak", 10), ("fir", 20)], "tree string, age int")
    cleaned, summary = run.clean(df, [{"type": "drop_duplicates"}, {"type": "fill_missing", "column": "age", "strategy": "mean"}])
    assert rows(cleaned) == [("ash", 6.0), ("elm", 12.0), ("fir", 20.0), ("oak", 10.0)]
    assert [r["affected"] for r in summary.orderBy("step").collect()] == [1, 1]


def test_preview_writes_nothing_and_warns(harvest):
    df = harvest.withColumn("none", F.lit(None).cast("string"))
    out = run.preview(df, [{"type": "drop_duplicates"}], order_by=["plot"])
    stages = {r["stage"]: r for r in out["stages"].collect()}
    assert (stages["before"]["rows"], stages["after"]["rows"]) == (8, 7)
    assert (stages["before"]["duplicate_rows"], stages["after"]["duplicate_rows"]) == (1, 0)
    assert [r["column"] for r in out["warnings"].collect()] == ["none"]
    assert out["original_sample"].count() == 8 and out["cleaned_sample"].count() == 7


def test_cleaning_twice_changes_nothing(harvest):
    steps = [{"type": "drop_duplicates"}, {"type": "clean_text", "column": "crop", "strategy": "trim"}]
    once, _ = run.clean(harvest, steps)
    twice, summary = run.clean(once, steps)
    assert rows(once) == rows(twice)
    assert {r["affected"] for r in summary.collect()} == {0}


def test_title_and_trim(spark):
    df = spark.createDataFrame([(" \t o'neil mc-donald X2y\n ",), (None,)], "t string")
    trimmed = op.clean_text(df, "t", "trim")
    assert op.clean_text(trimmed, "t", "title").first()[0] == "O'Neil Mc-Donald X2Y"
    assert trimmed.where("t is null").count() == 1


def test_fill_mode_takes_smallest_on_ties_and_blank_without_values(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "t string, n int")
    assert sorted(r["t"] for r in op.fill_missing(df, "t", "mode").collect()) == ["a", "a", "b"]
    assert {r["n"] for r in op.fill_missing(df, "n", "mode").collect()} == {""}


def test_fill_constant_keeps_or_widens_the_type(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    kept = op.fill_missing(df, "n", "constant", 7)
    assert kept.dtypes == [("n", "int")] and sorted(r[0] for r in kept.collect()) == [1, 7]
    text = op.fill_missing(df, "n", "constant", "none")
    assert text.dtypes == [("n", "string")] and sorted(r[0] for r in text.collect()) == ["1", "none"]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    assert sorted(r[0] for r in op.fill_missing(df, "x", "mean").collect()) == [1.0, 2.0, 2.0, 3.0]
    assert op.drop_missing(df, "x").count() == 2


def test_casts(spark):
    df = spark.createDataFrame([("1", " YES "), ("x", "0"), (None, None), ("2024-03-01", "t")], "a string, b string")
    numbers = [r["a"] for r in op.cast_type(df, "a", "numeric").collect()]
    assert numbers == [1.0, None, None, None]
    assert [r["b"] for r in op.cast_type(df, "b", "boolean").collect()] == [True, False, False, True]
    dates = [r["a"] for r in op.cast_type(df, "a", "datetime").collect()]
    assert dates[3] == datetime.datetime(2024, 3, 1) and dates[:3] == [None] * 3
    assert op.affected_count(df, F.col("a"), op.cast_expr(df, "a", "numeric")).first()[0] == 3


def test_zscore_leaves_a_constant_column_and_nulls(spark):
    df = spark.createDataFrame([(5.0,)] * 3 + [(None,)], "x double")
    assert op.remove_outliers(df, "x", "z_score").count() == 4
    far = spark.createDataFrame([(0.0,)] * 30 + [(1000.0,), (None,)], "x double")
    assert op.remove_outliers(far, "x", "z_score").count() == 31
    assert op.remove_outliers(df.limit(0), "x", "iqr").count() == 0


def test_validation_follows_the_schema(harvest):
    ok = run.validate(
        harvest.schema,
        [{"type": "cast_type", "column": "crop", "target_type": "numeric"}, {"type": "fill_missing", "column": "crop", "strategy": "mean"}],
    )
    assert ok == [None, None]
    bad = [
        {"type": "fill_missing", "column": "kilos", "strategy": "average"},
        {"type": "fill_missing", "column": "kilos", "strategy": "ffill"},
        {"type": "clean_text", "column": "kilos", "strategy": "trim"},
        {"type": "remove_outliers", "column": "crop", "strategy": "iqr"},
        {"type": "cast_type", "column": "gone", "target_type": "string"},
        {"type": "shuffle_rows"},
    ]
    assert all(run.validate(harvest.schema, bad))
    for step in bad:
        with pytest.raises(TableError):
            run.clean(harvest, [step])


def test_boolean_is_not_numeric(spark):
    df = spark.createDataFrame([(True,), (None,)], "b boolean")
    with pytest.raises(TableError):
        op.fill_missing(df, "b", "mean")
    with pytest.raises(TableError):
        op.remove_outliers(df, "b", "iqr")


def test_casts_of_other_types(spark):
    df = spark.sql("SELECT true AS b, date '1970-01-02' AS d, 5 AS n, 2.5D AS x")
    assert op.cast_type(df, "b", "datetime").first()["b"] is None
    assert op.cast_type(df, "b", "numeric").first()["b"] == 1.0
    assert op.cast_type(df, "d", "numeric").first()["d"] == 86400.0
    assert op.cast_type(df, "n", "numeric").dtypes[2] == ("n", "int")
    assert op.cast_type(df, "x", "string").first()["x"] == "2.5"
    assert op.cast_type(df, "n", "boolean").first()["n"] is False
