"""Forests grown from cells: rows that no tree can tell apart are drawn together.

A bootstrap draws each row a number of times that has the Poisson distribution
with mean 1, so ``n`` equal rows together are drawn a number of times that has
the one with mean ``n``.  Rows with the same bins and label are thus drawn at
once; of numbers, the drawn labels of a cell are then summed up per tree.  The
trees are grown side by side, each from its own draws of the cells, by the rules
of Spark's forests: a random part of the features at each node, the best bound
between bins, down to pure nodes or the depth.  The result is stored as, and is,
Spark's forest model.

A task holds the cells of one tree.  If these have more than ``MOST_BINS`` entries,
Spark's own forest passes all rows level by level instead.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frequency import literal_rows
from ..session import materialize, scratch_path
from .cells import OnCells

# Executors have no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: entries (cells, of classes with their labels, times features) that a task may hold.
MOST_BINS = 8_000_000
# Entries of drawn cells that are sent, and of a node table that are summed up, at a time.
SENT, ENTRIES = 16_000_000, 2_000_000
# Spark's bound: children of less impurity are leaves.
PURE = 2.0**-52

SPLIT = "struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>"
NODE = (
    "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
    f"leftChild:int,rightChild:int,split:{SPLIT}>"
)
GROWN = (
    "treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
    "leftChild int, rightChild int, feature int, bound double"
)


def _matrix(column) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _drawn(trees: int, seed: int, classes: bool):
    """Per tree and cell how often its rows are drawn, and of numbers the sums of the drawn labels and their squares."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed & 0xFFFFFFFF, 0, TaskContext.get().partitionId()])
        for whole in batches:
            step = max(1, SENT // (trees * max(16, len(whole) and len(whole.column("bins")[0]))))
            for batch in (whole.slice(i, step) for i in range(0, len(whole), step)):
                bins, label = _matrix(batch.column("bins")), batch.column("label").to_numpy()
                counts = rng.poisson(batch.column("weight").to_numpy()[:, None], (len(batch), trees)).astype(float)
                if classes:
                    stats = [counts, label[:, None] * np.ones(trees)]
                else:
                    first = np.flatnonzero(np.r_[True, (bins[1:] != bins[:-1]).any(axis=1)])
                    y = label[:, None]
                    stats = [np.add.reduceat(x, first, axis=0) for x in (counts, counts * y, counts * y * y)]
                    bins = bins[first]
                kept = stats[0] > 0
                kept[0] = True  # so that every tree has a cell, whatever it drew
                cell, tree = np.nonzero(kept)
                columns = [pa.array(tree.astype(np.int32)), _lists(bins[cell]), *[pa.array(x[kept]) for x in stats]]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "bins", *_names(classes)])

    return draw


def _names(classes: bool) -> list[str]:
    return ["weight", "label"] if classes else ["weight", "total", "squares"]


def _weight(stats: np.ndarray, classes: int) -> np.ndarray:
    return stats.sum(axis=-1) if classes else stats[..., 0]


def _impurity(stats: np.ndarray, classes: int) -> np.ndarray:
    """Gini impurity or variance, rounded as Spark rounds it."""
    weight = np.maximum(_weight(stats, classes), 1)
    if classes:
        return 1.0 - ((stats / weight[..., None]) ** 2).sum(axis=-1)
    return (stats[..., 2] - stats[..., 1] * stats[..., 1] / weight) / weight


def _sums(place: np.ndarray, size: int, values: list[np.ndarray], classes: int) -> np.ndarray:
    """Statistics of the rows by place."""
    if classes:
        weight, label = values
        return np.bincount(place * classes + label.astype(np.int64), weight, size * classes).reshape(size, classes)
    return np.stack([np.bincount(place, v, size) for v in values], axis=1)


def grow(
    bins: np.ndarray, values: list[np.ndarray], edges: list[list[float]], per_node: int, depth: int, classes: int, rng: np.random.Generator,
) -> dict[str, np.ndarray]:
    """The nodes of one tree, level by level, children behind their parents."""
    levels, start, node = [], 0, np.zeros(len(bins), np.int64)
    active = 1
    for level in range(depth + 1):
        stats = _sums(node, active, values, classes)
        impurity, weight = _impurity(stats, classes), np.maximum(_weight(stats, classes), 1)
        found = {
            "stats": stats, "impurity": impurity, "gain": np.full(active, -1.0), "feature": np.full(active, -1),
            "cut": np.full(active, -1), "left": np.full(active, -1),
        }
        levels.append(found)
        open_nodes = (abs(impurity) >= PURE) & (level < depth)
        best = np.zeros(active)
        chosen = np.zeros((active, len(edges)), bool)
        np.put_along_axis(chosen, rng.random(chosen.shape).argsort(axis=1)[:, :per_node], True, axis=1)
        chosen &= open_nodes[:, None]
        for f in range(len(edges)):
            width = len(edges[f]) + 1
            nodes = np.flatnonzero(chosen[:, f])
            if width < 2 or not len(nodes):
                continue
            for some in np.array_split(nodes, math.ceil(len(nodes) * width * stats.shape[1] / ENTRIES)):
                at = np.full(active, -1)
                at[some] = np.arange(len(some))
                mine = np.flatnonzero(at[node] >= 0)
                place = at[node[mine]] * width + bins[mine, f] - 1
                table = _sums(place, len(some) * width, [v[mine] for v in values], classes).reshape(len(some), width, -1)
                left = table.cumsum(axis=1)[:, :-1]
                right = stats[some][:, None] - left
                less, more = _weight(left, classes), _weight(right, classes)
                gains = impurity[some][:, None] - (less * _impurity(left, classes) + more * _impurity(right, classes)) / weight[some][:, None]
                gains[(less < 0.5) | (more < 0.5)] = -1.0
                cut = gains.argmax(axis=1)
                gain = gains[np.arange(len(some)), cut]
                better = gain > best[some]
                won = some[better]
                best[won], found["gain"][won], found["feature"][won], found["cut"][won] = gain[better], gain[better], f, cut[better]
        split = found["feature"] >= 0
        start += active
        found["left"][split] = start + 2 * np.arange(split.sum())
        if not split.any():
            break
        rank = np.cumsum(split) - 1
        rows = np.flatnonzero(split[node])
        bins, values, node = bins[rows], [v[rows] for v in values], node[rows]
        right = bins[np.arange(len(bins)), found["feature"][node]] > found["cut"][node] + 1
        node, active = 2 * rank[node] + right, 2 * int(split.sum())
    nodes = {k: np.concatenate([x[k] for x in levels]) for k in levels[0]}
    return _pruned(nodes, np.cumsum([0, *[len(x["gain"]) for x in levels]]), classes)


def _pruned(nodes: dict[str, np.ndarray], starts: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Without leaves that predict the same as their sibling, as Spark's forests."""
    stats, left = nodes["stats"], nodes["left"]
    told = stats.argmax(axis=1).astype(float) if classes else stats[:, 1] / np.maximum(stats[:, 0], 1)
    kept = np.ones(len(left), bool)
    for lo, hi in zip(starts[-2::-1], starts[:0:-1]):
        inner = lo + np.flatnonzero(left[lo:hi] >= 0)
        a = left[inner]
        same = inner[(left[a] < 0) & (left[a + 1] < 0) & (told[a] == told[a + 1])]
        kept[left[same]] = kept[left[same] + 1] = False
        left[same] = nodes["feature"][same] = -1
        nodes["gain"][same] = -1.0
    ids = np.cumsum(kept) - 1
    nodes["left"] = np.where(left >= 0, ids[left], -1)
    return {k: v[kept] for k, v in (nodes | {"prediction": told}).items()}


def _grown(edges: list[list[float]], per_node: int, depth: int, classes: int, seed: int):
    """The nodes of a tree from its draws."""

    def grown(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        values = [table.column(c).to_numpy() for c in _names(classes > 0)]
        bins = _matrix(table.column("bins"))
        nodes = grow(bins, values, edges, per_node, depth, classes, np.random.default_rng([seed & 0xFFFFFFFF, 1, tree]))
        stats, told = nodes["stats"], nodes["prediction"]
        bound = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(nodes["feature"], nodes["cut"])])
        left = nodes["left"].astype(np.int32)
        columns = [
            np.full(len(left), tree, np.int32), np.arange(len(left), dtype=np.int32), told, nodes["impurity"], _lists(stats),
            _weight(stats, classes).astype(np.int64), nodes["gain"], left, np.where(left >= 0, left + 1, -1).astype(np.int32),
            nodes["feature"].astype(np.int32), bound,
        ]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in GROWN.split(", ")])

    return grown


class ForestOnCells:
    """Spark's estimator of a forest, whose trees are grown from the cells of the rows."""

    def __init__(self, estimator, classes: int, seed: int):
        self.estimator, self.classes, self.seed = estimator, classes, seed

    def fit(self, data: DataFrame):
        from .search import tasks_of

        binning = OnCells(self.estimator, True, self.seed)
        binned = binning.bins(data)
        edges = binned.getOrDefault(binned.edges)
        width = len(edges)
        rows = data.select(binned.array().cast("array<tinyint>").alias("bins"), "label")
        cells = materialize(rows.groupBy("bins", "label").agg(F.count(F.lit(1)).alias("weight")), "cells")
        n, low, top = cells.agg(F.count(F.lit(1)), F.min("label"), F.max("label")).first()
        # Of a label that does not vary, Spark's importances hang on the rounding of its sums by row.
        if low == top or (n if self.classes else cells.select("bins").distinct().count()) * width > MOST_BINS:
            return self.estimator.fit(data)
        classes = max(self.classes, int(top) + 1) if self.classes else 0
        trees = self.estimator.getNumTrees()
        share = width if trees == 1 else math.ceil(math.sqrt(width)) if classes else math.ceil(width / 3)
        stats = _names(classes > 0)
        # Neighbours share a task, so that few tasks have a part of the same cell.
        dealt = cells.repartitionByRange(tasks_of(data.sparkSession, n), "bins", "label").sortWithinPartitions("bins", "label")
        drawn = dealt.mapInArrow(
            _drawn(trees, self.seed, classes > 0),
            "tree int, bins array<tinyint>, " + ", ".join(f"{c} double" for c in stats),
        )
        if not classes:
            drawn = drawn.groupBy("tree", "bins").agg(*[F.sum(c).alias(c) for c in stats])
        grown = drawn.repartition(trees, "tree").groupBy("tree")
        return self.model(
            grown.applyInArrow(_grown(edges, share, self.estimator.getMaxDepth(), classes, self.seed), GROWN), width, classes
        )

    def model(self, nodes: DataFrame, width: int, classes: int):
        """Spark's model of the nodes: they are stored in its format, and read by it."""
        spark, path = nodes.sparkSession, scratch_path(nodes.sparkSession, "forest")
        leaf = F.col("feature") < 0
        bounds = F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("bound"))
        split = F.struct(F.col("feature"), bounds, F.lit(-1)).cast(SPLIT)
        columns = ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild"]
        nodes.select("treeID", F.struct(*columns, split).cast(NODE).alias("nodeData")).write.parquet(f"{path}/data")

        kind, model = ("classification", RandomForestClassificationModel) if classes else ("regression", RandomForestRegressionModel)
        known = self._metadata(f"org.apache.spark.ml.{kind}.{model.__name__}", self.estimator.uid, set())
        known |= {"numFeatures": width, "numTrees": self.estimator.getNumTrees()} | ({"numClasses": classes} if classes else {})
        literal_rows(spark, [{"value": json.dumps(known)}], "value string").coalesce(1).write.text(f"{path}/metadata")
        tree = f"org.apache.spark.ml.{kind}.DecisionTree{kind.title()}Model"
        own = {"numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate"}
        rows = [{"_1": t, "_2": json.dumps(self._metadata(tree, f"{self.estimator.uid}_{t}", own)), "_3": 1.0} for t in range(known["numTrees"])]
        literal_rows(spark, rows, "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        return model.load(path)

    def _metadata(self, name: str, uid: str, without: set[str]) -> dict:
        e = self.estimator
        params = [p for p in e.params if p.name not in without]
        return {
            "class": name, "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__, "uid": uid,
            "paramMap": {p.name: e.getOrDefault(p) for p in params if e.isSet(p)},
            "defaultParamMap": {p.name: e.getOrDefault(p) for p in params if e.hasDefault(p) and not e.isSet(p)},
        }

