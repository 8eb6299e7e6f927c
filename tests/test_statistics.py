import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import explore, preview, profile
from tablelens.plans import findings


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp")
    table = profile.quality_score(df).first().asDict()
    assert table == {"rows": 0, "columns": 3, "missing_cells": 0, "duplicate_rows": 0, "quality_score": 100.0}
    columns = by_column(profile.column_profile(df))
    assert {c: r["unique_count"] for c, r in columns.items()} == {"a": 0, "b": 0, "c": 0}
    assert {c: r["missing_pct"] for c, r in columns.items()} == {"a": 0.0, "b": 0.0, "c": 0.0}
    assert explore.describe_numeric(df).count() == 0
    assert explore.histogram(df, "a").count() == 0
    assert explore.outlier_summary(df).count() == 0
    assert by_column(explore.describe_categorical(df))["b"]["top_value"] is None
    assert explore.missing_row_distribution(df).count() == 0


def test_missing_columns_and_values(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, None, float("nan")), (None, None, float("nan"))], "a string, b string, c double")
    table = profile.quality_score(df).first()
    assert (table["missing_cells"], table["duplicate_rows"]) == (7, 1)
    assert table["quality_score"] == pytest.approx(100 - 50 * 7 / 9 - 50 / 3)
    columns = by_column(profile.column_profile(df))
    assert columns["a"]["dtype"] == "categorical" and columns["a"]["unique_count"] == 0
    assert columns["c"]["missing_count"] == 2 and columns["c"]["mean"] == 1.0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 9.0], [3.0] * 5, [1.5, 2.0, 2.0, 7.0, -3.0, 11.0]])
def test_moments_match_pandas(spark, values):
    s = pd.Series(values)
    r = explore.describe_numeric(spark.createDataFrame([(v,) for v in values], "x double")).first()
    for name, want in {
        "mean": s.mean(), "median": s.median(), "mode": s.mode()[0], "std": s.std(), "variance": s.var(),
        "q25": s.quantile(0.25), "q75": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurt(),
    }.items():
        if math.isnan(want):
            assert r[name] is None, name
        else:
            assert r[name] == pytest.approx(want, abs=1e-9), name


@pytest.mark.parametrize("values", [[4.0, 4.0], [0.0, 1.0, 1.0, 19.5, 20.0], [1.0, None, float("nan"), 2.0]])
def test_histogram_matches_numpy(spark, values):
    present = [v for v in values if v is not None and not math.isnan(v)]
    counts, edges = np.histogram(present, bins=20)
    got = explore.histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x").orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert [r["lower"] for r in got] + [got[-1]["upper"]] == pytest.approx(edges.tolist())


def test_correlation_is_pairwise_and_skips_constants(spark):
    rows = [(float(i), float(2 * i) if i % 3 else None, 7.0, float(-(i**2))) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = pd.DataFrame(rows, columns=list("abcd")).corr()
    got = {(r["column1"], r["column2"]): r["coefficient"] for r in explore.correlations(df).collect()}
    assert set(got) == {("a", "b"), ("a", "d"), ("b", "d")}
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y])


def test_whole_days(spark):
    df = spark.sql("SELECT timestamp '2024-01-01 23:00:00' AS t UNION ALL SELECT timestamp '2024-01-02 01:00:00'")
    assert explore.describe_datetime(df).first()["span_days"] == 0.0


def test_text_dates_need_all_sampled_values(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-01", "12"), (None, "soon", "13")], "a string, b string, c string")
    assert profile.date_columns(df) == ["a"]
    kinds = {r["column"]: r["kind"] for r in explore.classify_columns(df.withColumn("flag", F.lit(True))).collect()}
    assert kinds == {"a": "datetime", "b": "categorical", "c": "categorical", "flag": "categorical"}


def test_dates_are_judged_on_all_rows(spark):
    texts = [f"2024-01-{1 + i % 28:02d}" for i in range(999)]
    df = spark.createDataFrame([(t, t, t) for t in texts] + [("n/k", texts[0], None)], "late string, good string, gap string")
    assert profile.date_columns(df.coalesce(1)) == ["good", "gap"]


def test_sample_values_with_equal_keys(spark):
    df = spark.createDataFrame([(1, f"v{i:05d}") for i in range(5000, 0, -1)] + [(0, "w")], "k int, v string")
    got = [r["value"] for r in profile.sample_values(df, 5, ["k"], ["v"]).orderBy("rank").collect()]
    assert got == ["w", "v00001", "v00002", "v00003", "v00004"]


def test_sample_of_equal_rows(spark):
    assert explore.sample_exact(spark.range(0, 300000, 1, 4).selectExpr("1 AS a"), 250001).count() == 250001


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r[0] for r in explore.sample_exact(df, 100, ["id"]).collect()}
    again = {r[0] for r in explore.sample_exact(df.repartition(7), 100, ["id"]).collect()}
    assert len(first) == 100 and first == again
    assert explore.sample_exact(df, 5000).count() == 1000


def test_preview_operators(spark):
    df = spark.createDataFrame([(1, "nan"), (2, None), (3, "b")], "id int, t string")
    assert [r["id"] for r in preview.filter_any(df, "NAN").collect()] == [1]
    for direction in ("asc", "desc"):
        assert preview.sort_by(df, f"t:{direction}", ["id"]).collect()[-1]["id"] == 2
    assert [r["id"] for r in preview.tail(df, 2, ["id"]).collect()] == [2, 3]
    assert [r["id"] for r in preview.page(df, 2, 2, ["id"]).collect()] == [3]
    assert preview.sort_by(df, "unknown:asc", ["id"]).count() == 3


def test_sanitize_nested(spark):
    df = spark.sql("SELECT 3.14D AS a, double('NaN') AS b, array(1D, double('Infinity')) AS c, named_struct('x', float('-Infinity')) AS d")
    row = preview.sanitize_floats(df).first()
    assert (row["a"], row["b"], row["c"], row["d"]["x"]) == (3.14, None, [1.0, None], None)


def test_clean_table_is_excellent(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, kind string")
    s = findings.Statistics(df)
    found = s.findings()
    assert found.count() == 0
    health = findings.health(found, s.table).first()
    assert health["overall_health"] == "EXCELLENT" and health["total_findings"] == 0


def test_recommended_steps_run(spark):
    from tablelens.plans.cleaning_run import clean

    rows = [(i, float(i % 10) if i % 4 else None) for i in range(40)] + [(1, 1.0)] * 3
    df = spark.createDataFrame(rows, "k int, x double")
    steps = findings.steps_of(findings.recommend(findings.findings(df)))
    assert {"type": "fill_missing", "column": "x", "strategy": "median"} in steps and {"type": "drop_duplicates"} in steps
    cleaned, _ = clean(df, steps)
    table = profile.table_profile(cleaned).first()
    assert table["missing_cells"] == 0


def test_wide_table(spark):
    """More columns than one scan aggregates, and more than one row can be grouped by."""
    names = [f"c{i}" for i in range(95)]
    df = spark.range(20).select(*[(F.col("id") % (i + 1)).cast(("double", "int", "string")[i % 3]).alias(n) for i, n in enumerate(names)])
    columns = by_column(profile.column_profile(df.unionByName(df)))
    assert len(columns) == 95
    assert all(columns[f"c{i}"]["unique_count"] == min(i + 1, 20) for i in range(95))
    assert profile.table_profile(df.unionByName(df)).first()["duplicate_rows"] == 20


def test_zeros_and_nested_rows_group_as_equal(spark):
    rows = "SELECT * FROM VALUES (0.0D, array(1, 2), map('a', 1)), (-0.0D, array(1, 2), map('a', 1)) AS t(x, y, z)"
    df = spark.sql(rows)
    assert profile.table_profile(df).first()["duplicate_rows"] == 1
    assert by_column(profile.unique_by_column(df.select("x", "y")))["x"]["unique_count"] == 1


def test_decimal_modes(spark):
    df = spark.sql("SELECT * FROM VALUES (1.50BD), (1.50BD), (2.25BD) AS t(x)")
    r = explore.describe_numeric(df).first()
    assert r["mode"] == 1.5 and r["median"] == 1.5
