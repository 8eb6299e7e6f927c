import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import quantiles as q

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def check(df, column, values, final):
    got = q.exact_quantiles(df, [column], PROBS, final=final)[column]
    for p in PROBS:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("final", [1, 7, 100_000])
def test_against_brute_force(spark, final):
    rng = random.Random(1)
    values = [rng.lognormvariate(0, 5) for _ in range(3000)]
    check(spark.createDataFrame([(v,) for v in values], "x double"), "x", values, final)


@pytest.mark.parametrize("final", [1, 50])
def test_hot_values(spark, final):
    """A third of the rows hold one value, next to close neighbours."""
    values = [5.0] * 1000 + [5.0 + i * 1e-9 for i in range(1, 1000)] + [4.0 - i for i in range(1000)]
    check(spark.createDataFrame([(v,) for v in values], "x double"), "x", values, final)


@pytest.mark.parametrize("final", [1, 20])
def test_large_integers(spark, final):
    values = [2**62 + i for i in range(0, 4000, 3)]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    counts = {"x": len(values)}
    got = q.order_statistics(df, {"x": [0, 100, 1333]}, counts, final)
    assert got == {("x", r): values[r] for r in (0, 100, 1333)}


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (4.0, None)], "x double, y double")
    got = q.exact_quantiles(df, ["x", "y"], [0.5])
    assert got == {"x": {0.5: 2.5}, "y": {0.5: None}}
    assert q.exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": {0.5: None}}


def test_infinite_values(spark):
    values = [-math.inf, 1.0, 2.0, 3.0, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = q.exact_quantiles(df, ["x"], [0.0, 0.5, 1.0], final=1)["x"]
    assert got == {0.0: -math.inf, 0.5: 2.0, 1.0: math.inf}


def test_sketch_is_close(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    got = q.approximate_quantiles(df, ["x"], [0.5])["x"][0.5]
    assert abs(got - 50_000) < 1000


def test_many_columns_take_several_batches(spark, monkeypatch):
    monkeypatch.setattr(q, "BUFFERED_VALUES", 700)
    monkeypatch.setattr(q, "INTERVALS_PER_SCAN", 2)
    df = spark.range(1000).select(*[(F.col("id") * (i + 1) % 997).alias(f"c{i}") for i in range(5)])
    values = df.toPandas()
    got = q.exact_quantiles(df, df.columns, [0.3, 0.5], final=300)
    for c in df.columns:
        for p in (0.3, 0.5):
            assert got[c][p] == pytest.approx(values[c].quantile(p))
