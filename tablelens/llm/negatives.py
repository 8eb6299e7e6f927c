"""Hard negatives: rows of another label whose score with the anchor is near, but below, that of a positive.

Scores are integer inner products of vectors of whole numbers.  Vectors are
ordered by length and cut into buckets of about equal length.  For an anchor
of length |a| and a bucket whose longest vector is |v|, no vector scores s or
more unless its angle to the anchor is at most  arccos(s / (|a| |v|)):

* a bucket where that quotient is above 1 is skipped;
* in the others this angle bounds the value that a vector, scaled to length 1,
  can have in each coordinate.  The bucket keeps a sorted list per coordinate;
  the feasible ranges of the anchor's ``focus`` largest coordinates are looked
  up there and the sets of vectors in them intersected;
* vectors in all sets are verified by their exact scores.

s is the current k-th score of the anchor.  The longest vectors are searched
first, and what is found there is the floor for all other buckets.  This is
done twice, for the best rows of the anchor's label (positives), and for each
positive's interval of scores among the other labels.

Anchors come in blocks of bounded number; a task holds a block and a bucket,
whatever the number of rows, labels or copies of a vector.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part.  Only vectors of one dimension are compared.  Rows of the
anchor's id are neither positives nor negatives of it.  Equal scores go to the
smaller id.  Repeated rows are rows of their own, as anchors, positives and
negatives.  Scores beyond a 64-bit integer count as its nearest end.  A
positive with a score of 0 takes scores of 0, one below 0 has no negatives.  An
empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, scratch_path
from .integers import SCALE, products, whole

POSITIVES, NEGATIVES = 5, 10
# A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90
ANCHORS, BUCKET, FOCUS = 5_000, 2_048, 4
# Share of the vectors, the longest ones, that is searched first.
FIRST = 1 / 32
_LEAST = np.iinfo(np.int64).min
# More than rounding can change a cosine by.
SLACK = 1e-9


def sound(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), x.alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf)))
    return rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(finite)


def _lengths(v: np.ndarray) -> np.ndarray:
    top = np.abs(v).max(axis=1, initial=0)
    return top * np.sqrt(((v / np.where(top > 0, top, 1)[:, None]) ** 2).sum(axis=1))


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    picked = column.take(pa.array(rows))
    return picked.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


class Block:
    """Vectors of one dimension with their ids and labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scale: int):
        self.ids, self.labels, self.v = ids, labels, whole(vectors, scale)
        with np.errstate(over="ignore"):
            self.length = _lengths(self.v)
        self.unit = self.v / np.where(self.length > 0, self.length, 1)[:, None]

    def __len__(self) -> int:
        return len(self.ids)


class Bucket(Block):
    """Vectors of about equal length, with a sorted list per coordinate."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, scale: int):
        super().__init__(ids, labels, vectors, scale)
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)
        self.longest, self.shortest = self.length.max(), self.length.min()

    def candidates(self, unit: np.ndarray, length: float, least: int, focus: np.ndarray) -> np.ndarray | None:
        """Places of the vectors that may score ``least`` with one of this direction and length; None: all."""
        reach = length * (self.longest if least > 0 else self.shortest)
        if not reach > 0:
            return None if least <= 0 else np.empty(0, np.int64)
        cosine = least / reach - SLACK
        if cosine > 1:
            return np.empty(0, np.int64)
        if not cosine > -1 or not math.isfinite(reach):
            return None
        angle, own = math.acos(cosine), np.arccos(np.clip(unit[focus], -1, 1))
        low = np.where(own + angle < math.pi, np.cos(np.minimum(own + angle, math.pi)), -1) - SLACK
        high = np.where(own > angle, np.cos(np.maximum(own - angle, 0)), 1) + SLACK
        ranges = [(np.searchsorted(self.lists[:, f], a), np.searchsorted(self.lists[:, f], b, "right"), f) for f, a, b in zip(focus.tolist(), low, high, strict=True)]
        ranges.sort(key=lambda r: r[1] - r[0])
        begin, end, f = ranges[0]
        found = self.order[begin:end, f]
        for begin, end, f in ranges[1:]:
            if end - begin == len(self):
                continue
            inside = np.zeros(len(self), bool)
            inside[self.order[begin:end, f]] = True
            found = found[inside[found]]
        return found


class Best:
    """The k best (score, id) of each of several goals."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.copy()
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(floors)

    def add(self, goal: int, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(score):
            return
        s, i = np.concatenate([self.kept[goal][0], score]), np.concatenate([self.kept[goal][1], ids])
        order = np.lexsort((i, ~s))[: self.k]  # ~s orders as -s, without overflow
        self.kept[goal] = s[order], i[order]
        if len(order) == self.k:
            self.floor[goal] = max(self.floor[goal], s[order[-1]])

    def table(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.kept]
        goal = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        arrays = [goal, *(np.concatenate([x[c] for x in self.kept]) if sizes else np.empty(0, np.int64) for c in range(2))]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["goal", "score", "id"])


class Goals:
    """What is sought: per goal an anchor, the least and the most score; and whether labels are equal or differ."""

    def __init__(self, anchor: np.ndarray, least: np.ndarray, most: np.ndarray, same_label: bool, k: int):
        self.anchor, self.least, self.most, self.same_label, self.k = anchor, least, most, same_label, k


def searched(ordered: DataFrame, anchors: list[Block], goals: list[Goals], focus: int, bucket: int, scale: int) -> DataFrame:
    """(dim, goal, score, id): the best of each task; ``anchors`` and ``goals`` go together, one entry per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {a.v.shape[1]: (a, g, Best(g.least, g.k), np.argsort(-np.abs(a.unit), axis=1, kind="stable")[:, :focus]) for a, g in zip(anchors, goals, strict=True)}
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                if dim not in state:
                    continue
                rows = np.flatnonzero(dims == dim)
                for lo in range(0, len(rows), bucket):
                    here = rows[lo : lo + bucket]
                    _verify(Bucket(ids[here], labels[here], _matrix(batch.column(2), here), scale), *state[dim])
        for dim, (_, _, best, _) in state.items():
            found = best.table()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, dim, np.int32)), *found.columns], ["dim", *found.schema.names])

    return ordered.select("id", "label", "v").mapInArrow(run, "dim int, goal int, score long, id long")


def _verify(vectors: Bucket, anchors: Block, goals: Goals, best: Best, focus: np.ndarray) -> None:
    """Candidates of each anchor in a bucket, scored exactly and added to its goals."""
    if not len(goals.anchor):
        return
    wanted, first = np.unique(goals.anchor, return_index=True)  # goals of an anchor are neighbours
    least = np.minimum.reduceat(best.floor, first)
    sets = {}
    for a, s in zip(wanted.tolist(), least.tolist(), strict=True):
        found = vectors.candidates(anchors.unit[a], anchors.length[a], s, focus[a])
        if found is None or len(found):
            sets[a] = found
    everything = np.arange(len(vectors))
    some = everything if any(f is None for f in sets.values()) else np.unique(np.concatenate([*sets.values(), everything[:0]]))
    active = np.array(sorted(sets), np.int64)
    ends = dict(zip(wanted.tolist(), zip(first.tolist(), np.append(first[1:], len(goals.anchor)).tolist(), strict=True), strict=True))
    for lo in range(0, len(active), 256):
        part = active[lo : lo + 256]
        scores = products(anchors.v[part], vectors.v[some])
        for a, row in zip(part.tolist(), scores, strict=True):
            found = some if sets[a] is None else np.sort(sets[a])
            s = row if sets[a] is None else row[np.searchsorted(some, found)]
            right = ((vectors.labels[found] == anchors.labels[a]) == goals.same_label) & (vectors.ids[found] != anchors.ids[a])
            begin, end = ends[a]
            right &= s >= best.floor[begin:end].min()
            found, s = found[right], s[right]
            for goal in range(begin, end):
                good = (s >= best.floor[goal]) & (s <= goals.most[goal])
                best.add(goal, s[good], vectors.ids[found[good]])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("dim", "goal").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_two_waves(ordered: DataFrame, limit: float, anchors: list[Block], goals: list[Goals], k: int, focus: int, bucket: int, scale: int) -> DataFrame:
    """(dim, goal, score, id, rank): first among the longest vectors, whose k-th scores are floors among the others."""
    longest = F.col("length") >= limit
    first = materialize(_ranked(searched(ordered.where(longest), anchors, goals, focus, bucket, scale), k), "nearest-of-longest")
    known = first.where(F.col("rank") == k).select("dim", "goal", "score").toArrow()
    raised = []
    for a, g in zip(anchors, goals, strict=True):
        mine = known["dim"].to_numpy() == a.v.shape[1]
        least = g.least.copy()
        at = known["goal"].to_numpy()[mine]
        least[at] = np.maximum(least[at], known["score"].to_numpy()[mine])
        raised.append(Goals(g.anchor, least, g.most, g.same_label, g.k))
    rest = searched(ordered.where(~longest), anchors, raised, focus, bucket, scale)
    return _ranked(first.drop("rank").unionByName(rest), k)


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    most_anchors: int = ANCHORS, bucket: int = BUCKET, focus: int = FOCUS, scale: int = SCALE,
) -> DataFrame:
    """Negatives of each anchor and positive, ranked by score; ``is_anchor`` is a condition on ``id``.

    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vector_col, F.col(label) if isinstance(label, str) else label)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumns({"dim": F.size("v"), "length": length, "row": F.monotonically_increasing_id()}).where("dim > 0")
    rows = materialize(rows, "vectors")
    ordered = rows.repartitionByRange(parallelism(rows), "dim", F.col("length").desc(), "row").sortWithinPartitions("dim", F.col("length").desc(), "row")
    ordered = materialize(ordered, "length-buckets")
    asked = rows.where(is_anchor)
    blocks = math.ceil(asked.count() / most_anchors)
    limit = (rows.approxQuantile("length", [1 - FIRST], 0.005) or [0.0])[0]
    out = scratch_path(spark, "hard-negatives")
    spark.createDataFrame([], _MINED).write.parquet(out)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("id", "label", "v", "dim").toArrow()
        dims = block["dim"].to_numpy()
        anchors = []
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            anchors.append(Block(block["id"].to_numpy()[at], block["label"].to_numpy()[at], _matrix(block["v"].combine_chunks(), at), scale))
        if not anchors:
            continue
        top = np.iinfo(np.int64).max
        sought = [Goals(np.arange(len(a)), np.full(len(a), _LEAST), np.full(len(a), top), True, positives) for a in anchors]
        near = _in_two_waves(ordered, limit, anchors, sought, positives, focus, bucket, scale).orderBy("dim", "goal", "rank").toArrow()
        goals, pairs = [], []
        for a in anchors:
            mine_ = near.filter(pa.array(near["dim"].to_numpy() == a.v.shape[1]))
            score = mine_["score"].to_pylist()
            least = np.array([min(-(-low * s // 100), top) if s >= 0 else top for s in score], np.int64)
            most = np.array([high * s // 100 if s >= 0 else _LEAST for s in score], np.int64)
            anchor = mine_["goal"].to_numpy().astype(np.int64)
            goals.append(Goals(anchor, least, most, False, negatives))
            names = {"dim": pa.array(np.full(len(score), a.v.shape[1], np.int32)), "goal": pa.array(np.arange(len(score), dtype=np.int32))}
            pairs.append(pa.table({**names, "anchor_id": pa.array(a.ids[anchor]), "positive_id": mine_["id"], "positive_score": mine_["score"]}))
        found = _in_two_waves(ordered, limit, anchors, goals, negatives, focus, bucket, scale)
        known = spark.createDataFrame(pa.concat_tables(pairs))
        found.join(F.broadcast(known), ["dim", "goal"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
    return spark.read.schema(_MINED).parquet(out)


def report(vectors: DataFrame, **settings: int) -> DataFrame:
    """Every hundredth id is an anchor; labels of every seventh id move on by one, modulo ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", "label"), F.col("id") % 100 == 0, label=moved, **settings)
