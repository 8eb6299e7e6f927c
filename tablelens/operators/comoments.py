"""Pearson coefficients of very many column pairs from a fixed number of scans.

A task keeps, for all pairs at once, how many rows have both values and the
sums of the values, squares and products of those rows: a few matrix products
per batch of rows.  Tasks' sums are added up per pair by a grouped aggregation.

Values are taken relative to the mean of their column, so that the sums do not
cancel.  Where they do for a pair (the rows that both columns have lie far
from the mean, and close together), its coefficient is computed on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import value_of
from ..session import materialize

# Columns of one block; a task holds the sums of two blocks' pairs.
BLOCK = 512
# Share of the squares that must be left after subtracting the mean of the common rows.
LOSS = 1e-6
# Pairs that are computed on their own in one scan.
PAIRS_PER_SCAN = 100

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "infinite")


def _values(batch: pa.RecordBatch, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values relative to the centre with gaps as 0, and whether they are there, and infinite."""
    x = np.empty((batch.num_rows, len(centre)))
    for i, c in enumerate(batch.columns):
        x[:, i] = c.to_numpy(zero_copy_only=False)
    there, infinite = ~np.isnan(x), np.isinf(x)
    x -= centre
    x[~there | infinite] = 0.0
    return x, there.astype(float), infinite.astype(float)


def pair_sums(numbers: DataFrame, centre: Sequence[float], left: Sequence[int], right: Sequence[int]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy, infinite) of the pairs i < j of two blocks of columns."""
    middle, a, b = np.array(centre), np.array(left), np.array(right)
    i, j = (x.ravel() for x in np.meshgrid(a, b, indexing="ij"))
    upper = i < j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(_SUMS), len(a), len(b)))
        for batch in batches:
            x, there, infinite = _values(batch, middle)
            xa, xb, ta, tb, ia, ib = x[:, a].T, x[:, b], there[:, a].T, there[:, b], infinite[:, a].T, infinite[:, b]
            sums += (ta @ tb, xa @ tb, ta @ xb, (xa * xa) @ tb, ta @ (xb * xb), xa @ xb, ia @ tb + ta @ ib)
        found = sums.reshape(len(_SUMS), -1)[:, upper]
        columns = [pa.array(i[upper].astype(np.int32)), pa.array(j[upper].astype(np.int32)), *(pa.array(s) for s in found)]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", *_SUMS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS)
    return numbers.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def coefficients(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, coefficient) of the column pairs i < j; undefined ones are null or NaN.

    One scan finds means and constant columns, one the sums of up to ``BLOCK``
    columns (of more, one per pair of blocks).
    """
    numbers = df.select(*[value_of(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    row = numbers.agg(*[f(c).alias(f"{n}_{c}") for c in numbers.columns for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]).first()
    known = [row[f"least_{c}"] is not None and row[f"least_{c}"] < row[f"most_{c}"] for c in numbers.columns]
    varied = [i for i, k in enumerate(known) if k]
    schema = "i int, j int, coefficient double"
    if len(varied) < 2:
        return df.sparkSession.createDataFrame([], schema)
    centre = [row[f"mean_{c}"] if row[f"mean_{c}"] is not None and math.isfinite(row[f"mean_{c}"]) else 0.0 for c in numbers.columns]
    blocks = [varied[k : k + BLOCK] for k in range(0, len(varied), BLOCK)]
    sums = None
    for at, left in enumerate(blocks):
        for right in blocks[at:]:
            used = sorted({*left, *right})
            place = {c: p for p, c in enumerate(used)}
            part = pair_sums(numbers.select(*[f"c{c}" for c in used]), [centre[c] for c in used], [place[c] for c in left], [place[c] for c in right])
            name = F.array(*[F.lit(c) for c in used])
            part = part.withColumns({"i": name[F.col("i")], "j": name[F.col("j")]})
            sums = part if sums is None else sums.unionByName(part)
    sums = materialize(sums, "pair-sums")
    n = F.col("n")
    less = lambda xy, x, y: F.col(xy) - F.try_divide(F.col(x) * F.col(y), n)
    vx, vy = less("sxx", "sx", "sx"), less("syy", "sy", "sy")
    sound = (vx > LOSS * F.col("sxx")) & (vy > LOSS * F.col("syy"))
    r = F.try_divide(less("sxy", "sx", "sy"), F.sqrt(vx) * F.sqrt(vy))
    # Sums of products may exceed the product of the deviations by rounding.
    bounded = F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))
    exact = sums.where((F.col("infinite") == 0) & sound).select("i", "j", bounded.alias("coefficient"))
    left_over = [(x["i"], x["j"]) for x in sums.where((F.col("infinite") == 0) & (n > 1) & ~sound).select("i", "j").collect()]
    for k in range(0, len(left_over), PAIRS_PER_SCAN):
        exact = exact.unionByName(_singly(numbers, sorted(left_over)[k : k + PAIRS_PER_SCAN]))
    return exact


def _singly(numbers: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    wide = numbers.agg(*[stats.pearson(F.col(f"c{i}"), F.col(f"c{j}")).alias(f"r{k}") for k, (i, j) in enumerate(pairs)])
    rows = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"r{k}").alias("coefficient")) for k, (i, j) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))
