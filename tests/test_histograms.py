"""Histograms of all columns at once: equal to one by one, infinities apart, two scans."""

import math

import numpy as np
import pytest

from tablelens.operators import explore
from tablelens.plans import report

INF = float("inf")


def test_all_columns_as_numpy_has_them(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)) * [1, 1e-9, 1e9, 1, 1]
    x[:, 3] = 7.0
    rows = [tuple(None if rng.random() < 0.1 else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, `b.c` double, d double, same double, e double")
    found = {}
    for r in explore.histograms(df, bins=7).collect():
        found.setdefault(r.column, {})[r.bin] = r
    assert list(found) and set(found) == set(df.columns)
    for i, c in enumerate(df.columns):
        counts, edges = np.histogram([r[i] for r in rows if r[i] is not None], bins=7)
        assert [found[c][b]["count"] for b in range(7)] == counts.tolist(), c
        assert [found[c][b].lower for b in range(7)] == pytest.approx(edges[:-1].tolist())
        assert found[c][6].upper == pytest.approx(edges[-1])


def test_infinities_are_counted_apart(spark):
    rows = [(v,) for v in [1.0, 2.0, 3.0, INF, INF, -INF, float("nan"), None]]
    df = spark.createDataFrame(rows, "x double")
    got = {r.bin: (r.lower, r.upper, r["count"]) for r in explore.histogram(df, "x", 2).collect()}
    assert got == {0: (1.0, 2.0, 1), 1: (2.0, 3.0, 2), explore.BELOW: (-INF, -INF, 1), explore.ABOVE: (INF, INF, 2)}
    only = {r.bin: r["count"] for r in explore.histogram(df.where("x = double('inf')"), "x").collect()}
    assert only == {explore.ABOVE: 2}
    wide = [r["count"] for r in explore.histogram(spark.createDataFrame([(-1.7e308,), (0.1,), (1.7e308,)], "x double"), "x", 4).orderBy("bin").collect()]
    assert wide == [1, 0, 1, 1]
    assert explore.histograms(df.where("x > 9 AND x < 9")).count() == 0


def test_twenty_columns_take_two_scans(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr(*[f"id * {i + 1} AS v{i}" for i in range(20)]).write.parquet(path)
    df = spark.read.parquet(path)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("histograms", "")
    try:
        assert explore.histograms(df, bins=5).count() == 100
        assert len(tracker.getJobIdsForGroup("histograms")) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_report_has_distributions_and_gaps(spark):
    df = spark.createDataFrame([(k, None if k % 4 else float(k), "x" if k % 2 else None) for k in range(40)], "k long, v double, t string")
    info = {"dataset_id": "d", "dataset_name": "n", "original_filename": "f", "created_at": "2024-01-01T00:00:00", "active_version": 1, "file_size_bytes": 1, "user_id": "u"}
    doc = report.report_document(report.ReportSource(df, info, order_by=["k"])).first()
    bins = [(b.column, b.bin, b["count"]) for b in doc.eda.charts.distributions]
    assert len(bins) == 40 and sum(n for c, _, n in bins if c == "v") == 10 and bins == sorted(bins, key=lambda b: b[0] == "v")
    assert [(c.column, c.missing_count) for c in doc.eda.missing.columns] == [("v", 30), ("t", 20)]
    assert sum(r.rows for r in doc.eda.missing.rows) == 40 and not math.isnan(doc.quality.quality_score)
