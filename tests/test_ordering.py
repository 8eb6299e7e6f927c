import random

import pytest
from pyspark.sql import functions as F

from tablelens.operators import ordering
from tablelens.operators.cleaning import fill_missing


def brute(rows, forward):
    """Fill in the documented order: keys, then values, missing last (first when backward)."""
    out, last = [], None
    if forward:
        order = sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    else:
        order = sorted(rows, key=lambda r: (-r[0], r[1] is None, -(r[1] or 0)))
    for k, v in order:
        last = v if v is not None else last
        out.append((k, last))
    return sorted(out, key=str)


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("hot", [False, True])
def test_fill_against_brute_force(spark, forward, hot):
    rng = random.Random(3)
    rows = [(7 if hot and rng.random() < 0.4 else rng.randrange(400), rng.randrange(50) if rng.random() < 0.3 else None) for _ in range(900)]
    df = spark.createDataFrame(rows, "k int, v int")
    got = fill_missing(df, "v", "ffill" if forward else "bfill", order_by=["k"])
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(rows, forward)


def test_fill_within_parts(spark):
    rng = random.Random(4)
    rows = [(f"p{rng.randrange(3) if rng.random() < 0.6 else 0}", i, i if rng.random() < 0.2 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "p string, k int, v int")
    got = {(r["p"], r["k"]): r["v"] for r in fill_missing(df, "v", "ffill", order_by=["k"], partition_by=["p"]).collect()}
    last, want = {}, {}
    for p, k, v in rows:
        last[p] = v if v is not None else last.get(p)
        want[p, k] = last[p]
    assert got == want


def test_fill_with_missing_parts_and_nothing_before(spark):
    rows = [(None, 1, None), (None, 2, 5), (None, 3, None), ("a", 4, None)]
    df = spark.createDataFrame(rows, "p string, k int, v int")
    got = fill_missing(df, "v", "ffill", order_by=["k"], partition_by=["p"]).orderBy("k")
    assert [r["v"] for r in got.collect()] == [None, 5, 5, None]


def test_running_totals(spark):
    rng = random.Random(5)
    keys = rng.sample(range(10_000), 800)
    rows = [(k, rng.randrange(10)) for k in keys]
    got = ordering.running_totals(spark.createDataFrame(rows, "k int, n int"), ["k"], {"before": F.col("n")})
    total, want = 0, {}
    for k, n in sorted(rows):
        want[k] = total
        total += n
    assert {r["k"]: r["before"] for r in got.collect()} == want


@pytest.mark.parametrize("strategy", ["ffill", "bfill"])
def test_fill_within_many_parts_over_many_blocks(spark, strategy):
    """Blocks that hold parts' ends and starts, and one part that spans blocks."""
    rng = random.Random(6)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(60), i, i if rng.random() < 0.05 else None) for i in range(2000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "p int, k int, v int")
        got = {r["k"]: r["v"] for r in fill_missing(df, "v", strategy, order_by=["k"], partition_by=["p"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    last, want = {}, {}
    for p, k, v in rows if strategy == "ffill" else reversed(rows):
        last[p] = v if v is not None else last.get(p)
        want[k] = last[p]
    assert got == want
