"""Search where rows repeat ids and vectors: every pair of rows counts, as in the SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import balltree


def brute_rows(rows, k=5):
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        pairs = sorted((-int(v @ w), j) for i, v in whole if i == q for j, w in whole if j != q)[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(pairs)]
    return out


@pytest.mark.parametrize("sizes", [(20_000, 2_000, 128), (20, 2, 4)])
@pytest.mark.parametrize("copies", [2, 3, 6])
def test_repeated_rows_against_brute_force(spark, sizes, copies):
    rng = np.random.default_rng(7)
    rows = [(k, rng.integers(-8, 8, 3).astype(float).tolist()) for k in range(120)]
    rows += [(7, [90.0, 90.0, 90.0])] * copies  # the top vector of many queries
    rows += [(8, [80.0 + k, -3.0, 2.0]) for k in range(30)]  # an id of many vectors
    rows += [rows[50]] * 2 + [(100, [1.0, -5.0, 2.0])]  # repeated and differing query rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shard, block, leaf = sizes
    found = balltree.top_k(table, F.col("id") % 50 == 0, shard=shard, block=block, leaf=leaf)
    assert sorted(tuple(r) for r in found.collect()) == brute_rows(rows)


@pytest.mark.parametrize("scale", [5e4, 3e8, 1e12, 1e30, 1e250])
def test_large_components(spark, scale):
    """Exact below the range of a 64-bit integer, its end beyond."""
    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=5) * scale).tolist()) for k in range(120)] + [(200, [0.0] * 5), (250, [scale] * 5), (300, []), (350, [1.0, scale])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v]
    expected = []
    for q, v in ok:
        if q % 50 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in ok if i != q and len(w) == len(v)]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5])]
    found = balltree.top_k(table, F.col("id") % 50 == 0, shard=30, block=2, leaf=4)
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)
