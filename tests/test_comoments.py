"""Correlations of many columns: equal to the formula per pair, in few scans."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import comoments, explore


def table(spark, x, names=None):
    rows = [tuple(None if v is None or (isinstance(v, float) and math.isnan(v) and (i + k) % 2) else float(v) for i, v in enumerate(r)) for k, r in enumerate(x.tolist())]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names or [f"v{i}" for i in range(x.shape[1])]))


def by_pair(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 2 or np.isinf(a).any() or np.isinf(b).any() or a.min() == a.max() or b.min() == b.max():
        return None
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / math.sqrt((a @ a) * (b @ b)))


def awkward(n=300, k=24):
    """Gaps, an infinity, constants, a large offset, values that are constant where others are there."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, k)) + rng.normal(size=(n, k)) * 0.5
    x[rng.random((n, k)) < 0.2] = np.nan
    x[:, 3] = 7.25
    x[:, 4] = np.nan
    x[:, 5] += 1e9
    x[7, 6] = np.inf
    x[: n // 2, 8], x[n // 2 :, 9] = 1e6, np.nan  # where 9 is there, 8 is far from its mean and does not vary
    x[: n // 2, 10] = 1e6 + rng.normal(size=n // 2) * 1e-3  # there it varies a little
    x[10:, 11], x[:10, 12] = np.nan, np.nan  # no common row
    return x


def test_blocks_against_the_formula_per_pair(spark, monkeypatch):
    x = awkward()
    df, k = table(spark, x), x.shape[1]
    expected = {(i, j): by_pair(x, i, j) for i in range(k) for j in range(i + 1, k)}
    expected = {p: r for p, r in expected.items() if r is not None}
    for block in (512, 7):
        monkeypatch.setattr(comoments, "BLOCK", block)
        found = {(r.i, r.j): r.coefficient for r in comoments.coefficients(df, df.columns).collect()}
        found = {p: r for p, r in found.items() if r is not None and not math.isnan(r)}
        assert found.keys() == expected.keys()
        assert all(found[p] == pytest.approx(r, abs=1e-6) for p, r in expected.items())


def test_wide_and_narrow_tables_give_the_same_rows(spark, monkeypatch):
    x = awkward(k=14)
    df = table(spark, x, [f"a.{i}" for i in range(14)])
    narrow = explore.correlations(df, threshold=0.3).orderBy("pair").collect()
    monkeypatch.setattr(explore, "PAIRS_PER_SCAN", 3)
    wide = explore.correlations(df, threshold=0.3).orderBy("pair").collect()
    assert [r[:3] for r in wide] == [r[:3] for r in narrow] and len(wide) > 20
    assert [r.coefficient for r in wide] == pytest.approx([r.coefficient for r in narrow], abs=1e-6)
    assert [r.pair for r in wide] == [i * 14 - i * (i + 1) // 2 + j - i - 1 for i, j in ((int(r.column1[2:]), int(r.column2[2:])) for r in wide)]


def test_two_hundred_columns_take_at_most_four_scans(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 200))
    x[:, 1] = x[:, 0] * 2 + 1
    path = str(tmp_path / "wide.parquet")
    table(spark, x).write.parquet(path)
    tracker, before = spark.sparkContext.statusTracker(), None
    spark.sparkContext.setJobGroup("wide-correlation", "")
    try:
        found = explore.correlations(spark.read.parquet(path), threshold=0.9).collect()
        jobs = tracker.getJobIdsForGroup("wide-correlation")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.column1, r.column2) for r in found] == [("v0", "v1")]
    # Jobs: the listing of the folder, the means and their exchange, the sums and their exchange, the result.
    assert len(jobs) <= 8, before


def test_tables_without_pairs(spark):
    df = spark.createDataFrame([], ", ".join(f"v{i} double" for i in range(20)))
    assert explore.correlations(df).count() == 0
    assert comoments.coefficients(df, df.columns).count() == 0
    one = spark.createDataFrame([tuple(float(i) for i in range(20))], df.schema)
    assert comoments.coefficients(one, one.columns).count() == 0
    assert explore.correlations(df.select(F.col("v0"))).count() == 0
