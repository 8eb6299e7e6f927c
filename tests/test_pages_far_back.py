"""Pages of an ordered table: the rows are those of the whole order, and no far page orders what lies before it."""

import random

import pytest
from compare import plan
from pyspark.sql import functions as F

from tablelens.operators import pages, preview


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(pages, "RANGE", 20)
    monkeypatch.setattr(pages, "RANGES", 4)


def ordered(rows, descending=False):
    """By the second column with missing last, then by the first."""
    there = sorted((r for r in rows if r[1] is not None), key=lambda r: r[0] if r[0] is not None else -1)
    there.sort(key=lambda r: r[1], reverse=descending)
    return there + sorted((r for r in rows if r[1] is None), key=lambda r: r[0])


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("kind", ["double", "string"])
def test_pages_are_those_of_the_whole_order(spark, small_ranges, direction, kind):
    rng = random.Random(2)
    cell = lambda: rng.choice([None, float("nan"), rng.random(), 0.5, 0.5]) if kind == "double" else rng.choice([None, "", "é", "same", str(rng.random())])
    rows = [(k, cell()) for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"k long, v {kind}").repartition(5)
    clean = [(k, None if v != v else v) for k, v in rows]
    want = ordered(clean, direction == "desc")
    for page, size in ((1, 7), (3, 7), (20, 7), (50, 10), (9, 50), (51, 10), (1000, 10)):
        found = preview.page(df, page, size, ["k"], f"v:{direction}").collect()
        assert [r.k for r in found] == [k for k, _ in want[(page - 1) * size : page * size]], (page, size)


def test_rows_of_one_key(spark, small_ranges):
    """Keys that many rows share: pages have their size and no row twice."""
    df = spark.createDataFrame([(1, k) for k in range(150)] + [(0, -1), (2, 200)], "k int, n int").coalesce(1)
    parts = [preview.page(df, p, 16, ["k"]).collect() for p in range(1, 11)]
    assert [len(p) for p in parts] == [16] * 9 + [8]
    assert [r.k for p in parts for r in p] == [0] + [1] * 150 + [2]


def test_one_key_before_all_others(spark, small_ranges):
    df = spark.createDataFrame([(0, k) for k in range(3000)] + [(1 + k, k) for k in range(40)], "k int, n int").coalesce(1)
    for offset in (0, 10, 2990, 3000, 3008, 3024):
        assert [r.k for r in preview.page(df, offset // 8 + 1, 8, ["k"]).collect()] == ([0] * 3000 + list(range(1, 41)))[offset // 8 * 8 :][:8]


def test_next_page(spark):
    df = spark.createDataFrame([(k, k % 3 if k % 4 else None) for k in range(40)], "k int, v int")
    first = preview.page(df, 1, 12, ["k"], "v:desc").collect()
    second = preview.next_page(df, (first[-1].v, first[-1].k), 12, ["k"], "v:desc").collect()
    assert second == preview.page(df, 2, 12, ["k"], "v:desc").collect()


def test_a_far_page_has_no_offset(spark):
    df = spark.range(0, 200_000, 1, 8).select((F.col("id") * 7919 % 200_003).alias("k"), "id")
    keys = sorted(i * 7919 % 200_003 for i in range(200_000))
    far = preview.page(df, 15_000, 10, ["k"])
    assert [r.k for r in far.collect()] == keys[149_990:150_000]
    text = plan(far).lower()
    assert "takeordered" in text and "offset" not in text
    assert preview.page(df, 10**6, 10, ["k"]).count() == 0
