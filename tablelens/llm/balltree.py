"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Equal rows (id and vector) are one with a count.  They are dealt to the nearest
of a few pivot vectors and stored in that order once; a shard is a run of rows
of one pivot, so its vectors lie close together, and neither copies nor an id
of many vectors fill one.  A shard's tree splits its vectors between two far
ones until a leaf holds at most ``leaf``; a node knows the centre c and radius
r of its ball, and no vector in it has a larger inner product with q than
q.c + |q| r.  A block of queries goes down the tree together: the child with
the larger bound first, and queries whose k-th score is above a node's bound
skip it.

The k-th score is shared between shards: a task takes it from shard to shard,
and vectors are searched in waves, a small share first, whose k-th scores are
floors in the next.  The waves' results are merged by rank.

Queries come to the shards in blocks of bounded number; vectors stay where they
are stored, and a task holds a block and a shard, however long the table is.

Components become floor(256 x), inner products are exact whole numbers; those
beyond a 64-bit integer count as its nearest end.  Vectors that are null,
empty, or hold null or non-finite components, take no part, nor do rows without
id.  Only vectors of equal length are compared.  Ties go to the smaller id.
Rows of one id are no candidates for each other.  Copies count as rows, as in
SQL: a candidate takes a rank for each pair of a row of the query id and a row
of it.  An empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import materialize, parallelism, scratch_path
from .integers import SCALE, whole
from .integers import products as _products

K = 5
SHARD, BLOCK, LEAF = 20_000, 2_000, 128
# Vectors to which others are dealt, and the shares of the vectors up to which the waves go.
PIVOTS = 64
WAVES = (1 / 64, 1 / 8, 1.0)
_NONE = np.iinfo(np.int64).min


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return rows.where("id IS NOT NULL AND size(v) > 0").where(finite).withColumn("dim", F.size("v"))


class BallTree:
    """Nodes in order of creation; the vectors of a node are consecutive."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int):
        self.order = np.argsort(ids, kind="stable")  # where the vectors were before
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.begin, self.end, self.left = [], [], []
        self.centre, self.radius = [], []
        self._grow(0, len(ids), leaf)

    def _grow(self, lo: int, hi: int, leaf: int) -> None:
        todo = [self._node(lo, hi)]
        while todo:
            node = todo.pop()
            lo, hi = self.begin[node], self.end[node]
            if hi - lo <= leaf or not self.radius[node] > 0:
                continue
            part = self.vectors[lo:hi]
            a = part[np.argmax(((part - self.centre[node]) ** 2).sum(axis=1))]
            b = part[np.argmax(((part - a) ** 2).sum(axis=1))]
            side = part @ (b - a)
            cut = np.argsort(side, kind="stable")
            self.vectors[lo:hi], self.ids[lo:hi], self.order[lo:hi] = part[cut], self.ids[lo:hi][cut], self.order[lo:hi][cut]
            middle = lo + (hi - lo) // 2
            self.left[node] = self._node(lo, middle)
            self._node(middle, hi)
            todo += [self.left[node], self.left[node] + 1]

    def _node(self, lo: int, hi: int) -> int:
        part = self.vectors[lo:hi]
        centre = part.mean(axis=0) if hi > lo else np.zeros(self.vectors.shape[1])
        self.begin.append(lo)
        self.end.append(hi)
        self.left.append(-1)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max(initial=0))))
        return len(self.begin) - 1

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the k best scores (the least integer where there are fewer or all others are below ``floor``) and their ids."""
        score, best, _ = self.search_places(ids, queries, floor, k)
        return score, best

    def search_places(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``search``, and the places of the vectors as they were given."""
        n = len(ids)
        floor = np.where(np.isneginf(floor), _NONE, floor).astype(np.int64)
        score, best, where = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64)
        with np.errstate(over="ignore"):
            norm = np.sqrt((queries**2).sum(axis=1))
        centre, radius = np.array(self.centre), np.array(self.radius)

        def bound(which: np.ndarray, node: int) -> np.ndarray:
            with np.errstate(over="ignore", invalid="ignore"):
                a, b = queries[which] @ centre[node], norm[which] * radius[node]
                b = a + b + 1e-9 * (np.abs(a) + np.abs(b)) + 1e-6  # never below the true one by rounding
            return np.where(np.isnan(b), np.inf, b)

        todo = [(0, np.arange(n))]
        while todo:
            node, which = todo.pop()
            which = which[bound(which, node) >= np.maximum(floor[which], score[which, -1])]
            if not len(which):
                continue
            if self.left[node] >= 0:
                a, b = self.left[node], self.left[node] + 1
                nearer_b = bound(which, b).mean() > bound(which, a).mean()
                todo += [(a, which), (b, which)] if nearer_b else [(b, which), (a, which)]
                continue
            lo, hi = self.begin[node], self.end[node]
            here = _products(queries[which], self.vectors[lo:hi])
            here[ids[which][:, None] == self.ids[None, lo:hi]] = _NONE
            both = np.concatenate([score[which], here], axis=1)
            names = np.concatenate([best[which], np.broadcast_to(self.ids[lo:hi], here.shape)], axis=1)
            order = np.lexsort((names, ~both), axis=1)[:, :k]  # ~x orders as -x, without overflow
            score[which] = np.take_along_axis(both, order, axis=1)
            best[which] = np.take_along_axis(names, order, axis=1)
            places = np.concatenate([where[which], np.broadcast_to(self.order[lo:hi], here.shape)], axis=1)
            where[which] = np.take_along_axis(places, order, axis=1)
        return score, best, where


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with ``pivot``: the number of the nearest one of the pivots of their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, found = batch.column(2).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim, known in pivots.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    x = _matrix(batch.column(1).take(pa.array(at)))
                    with np.errstate(over="ignore", invalid="ignore"):
                        found[at] = np.argmin((known**2).sum(axis=1)[None, :] - 2 * (x @ known.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "pivot"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pivot", IntegerType())]))


_FOUND = "query long, vec_id long, score long, n long"


def _searched(shards: DataFrame, queries: dict[int, tuple[np.ndarray, ...]], k: int, shard: int, leaf: int, scale: int) -> DataFrame:
    """(query, vec_id, score, n): each task's best k per query; ``queries``: number, id, vector and floor by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dim: [np.full((len(q[0]), k), _NONE), np.zeros((len(q[0]), k), np.int64), np.zeros((len(q[0]), k), np.int64), q[3].copy()] for dim, q in queries.items()}
        held: list[pa.RecordBatch] = []
        now, size = None, 0

        def search() -> None:
            if not held or now[0] not in queries:
                return
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            vectors = whole(np.concatenate([_matrix(b.column(1)) for b in held]), scale)
            copies = np.concatenate([b.column(4).to_numpy() for b in held])
            _, query_ids, q, _ = queries[now[0]]
            score, vec_id, n, floor = best[now[0]]
            here, names, where = BallTree(ids, vectors, leaf).search_places(query_ids, q, floor, k)
            both = np.concatenate([score, here], axis=1)
            all_ids, all_n = np.concatenate([vec_id, names], axis=1), np.concatenate([n, copies[where]], axis=1)
            order = np.lexsort((all_ids, ~both), axis=1)[:, :k]
            best[now[0]] = [np.take_along_axis(x, order, axis=1) for x in (both, all_ids, all_n)]
            best[now[0]].append(np.maximum(floor, best[now[0]][0][:, -1]))

        for batch in batches:
            dim, pivot = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = np.flatnonzero((dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                while lo < hi:
                    place = (int(dim[lo]), int(pivot[lo]))
                    if place != now or size >= shard:
                        search()
                        now, held, size = place, [], 0
                    take = min(hi - lo, shard - size)
                    held.append(batch.slice(lo, take))
                    size += take
                    lo += take
        search()
        for dim, (score, vec_id, n, _) in best.items():
            found = score > _NONE
            number = np.repeat(queries[dim][0], k).reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (number, vec_id, score, n)], ["query", "vec_id", "score", "n"])

    return shards.select("id", "v", "dim", "pivot", "n").mapInArrow(run, _FOUND)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF, scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores among all rows but its own."""
    spark = vectors.sparkSession
    one = sound(vectors, id_col, vector_col).groupBy("id", "v", "dim").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(one.withColumn("number", F.monotonically_increasing_id()), "vectors")
    chosen = rows.orderBy(F.xxhash64("number"), "number").limit(PIVOTS).select("v", "dim").collect()
    pivots = {d: np.array([r["v"] for r in chosen if r["dim"] == d]) for d in sorted({r["dim"] for r in chosen})}
    near = _nearest(rows.select("id", "v", "dim", "n", "number"), pivots)
    order = ("dim", "pivot", "number")
    shards = materialize(near.repartitionByRange(parallelism(rows), *order).sortWithinPartitions(*order), "shards")
    asked = rows.where(is_query)
    blocks = math.ceil(asked.count() / block)
    out = scratch_path(spark, "neighbours")
    spark.createDataFrame([], _FOUND).write.parquet(out)
    share = F.pmod(F.xxhash64(F.lit(5), F.col("number")), F.lit(1 << 20)) / float(1 << 20)
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", "id", "v", "dim").toArrow()
        dims = mine["dim"].to_numpy()
        queries = {}
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            number, ids = (mine[c].to_numpy()[at] for c in ("number", "id"))
            queries[dim] = (number, ids, whole(_matrix(mine["v"].combine_chunks().take(pa.array(at))), scale), np.full(len(at), _NONE))
        best, before = None, 0.0
        for upto in WAVES:
            wave = _searched(shards.where((share >= before) & (share < upto)), queries, k, shard, leaf, scale)
            best = wave if best is None else best.unionByName(wave)
            ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
            best = materialize(best.withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= k), "wave")
            known = best.where(F.col("at") == k).select("query", "score").toArrow()
            floors = dict(zip(known["query"].to_pylist(), known["score"].to_pylist(), strict=True))
            queries = {d: (*q[:3], np.array([floors.get(x, _NONE) for x in q[0].tolist()], np.int64)) for d, q in queries.items()}
            best, before = best.drop("at"), upto
        best.write.mode("append").parquet(out)
    found = spark.read.schema(_FOUND).parquet(out)
    asked = rows.where(is_query).select(F.col("number").alias("query"), F.col("id").alias("query_id"), F.col("n").alias("copies"))
    first = Window.partitionBy("query_id").orderBy("below", "vec_id")
    kept = (
        found.join(asked, "query")
        .select("query_id", F.bitwise_not("score").alias("below"), "vec_id", F.least(F.col("n") * F.col("copies"), F.lit(k)).cast("int").alias("n"))
        .withColumn("at", F.row_number().over(first))
        .where(F.col("at") <= k)
    )
    best = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("below", "vec_id", "n"))).alias("found"))
    best = best.select("query_id", F.slice(F.flatten(F.transform("found", lambda f: F.array_repeat(f, f["n"]))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "found")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("found.vec_id").alias("vec_id"), F.bitwise_not(F.col("found.below")).alias("score")
    )


def report(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"), F.col("id") % 50 == 0)
