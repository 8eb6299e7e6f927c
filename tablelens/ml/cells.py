"""Boosted trees fitted to cells: rows that no tree can tell apart are one weighted row.

A tree of Spark's cuts the values of a feature into at most ``BINS`` bins and
sees the bins only.  Rows with the same bins fall into the same leaves of every
tree, so boosting needs their number and, of classes, their label; of numbers
the mean label: the squared loss is the same but for a constant.  The rounds
then run over the cells.  Their number is at most that of the rows, and does
not grow with the rows once all combinations of bins have occurred.

Forests draw cells by tree, see ``forest``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Spark's bins per feature, and the rows that Spark chooses their bounds from.
BINS, BOUND_ROWS = 32, 10_000


def bounds(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Upper bounds of all bins of a feature but the last: between all values, or else of about equal numbers of rows."""
    known, counts = np.unique(values, return_counts=True)
    between = (known[:-1] + known[1:]) / 2
    if len(between) < bins:
        return between.tolist()
    step = len(values) / bins
    found, seen, wanted = [], np.cumsum(counts), step
    for k in range(1, len(known)):
        if abs(seen[k - 1] - wanted) < abs(seen[k] - wanted):
            found.append(float(between[k - 1]))
            wanted += step
    return found


class Binned(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """The number, from 1, of the bin of each entry of ``features``, in ``binned``."""

    edges = Param(Params._dummy(), "edges", "upper bounds of the bins of each entry")

    @keyword_only
    def __init__(self, *, edges: list[list[float]] | None = None):
        super().__init__()
        if edges is not None:
            self._set(edges=edges)

    def array(self):
        edges = F.array(*[F.array(*[F.lit(float(x)) for x in e]).cast("array<double>") for e in self.getOrDefault(self.edges)])
        return F.zip_with(vector_to_array("features"), edges, lambda x, e: F.lit(1) + F.size(F.filter(e, lambda edge: edge < x)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("binned", array_to_vector(self.array().cast("array<double>")))


class OnCells:
    """A boosted estimator with the columns ``binned``, ``label`` and ``weight`` that is fitted to the cells of the rows."""

    def __init__(self, estimator, classes: bool, seed: int):
        self.estimator, self.classes, self.seed = estimator, classes, seed

    def bins(self, data: DataFrame) -> Binned:
        n = data.count()
        # As Spark does: all rows, or about so many of a larger table, choose the bounds; all rows are binned and learned from.
        some = data if n <= BOUND_ROWS else data.sample(False, BOUND_ROWS / n, self.seed)
        rows = np.array([r[0] for r in some.select(vector_to_array("features")).collect()])
        return Binned(edges=[bounds(column) for column in rows.T])

    def cells(self, data: DataFrame, binned: Binned) -> DataFrame:
        rows = data.select(binned.array().alias("bins"), "label")
        weight = F.count(F.lit(1)).cast("double").alias("weight")
        grouped = rows.groupBy("bins", "label").agg(weight) if self.classes else rows.groupBy("bins").agg(F.avg("label").alias("label"), weight)
        return materialize(grouped.select(array_to_vector(F.col("bins").cast("array<double>")).alias("binned"), "label", "weight"), "cells")

    def fit(self, data: DataFrame) -> PipelineModel:
        from .search import spread

        binned = self.bins(data)
        return PipelineModel([binned, self.estimator.fit(spread(self.cells(data, binned)))])
