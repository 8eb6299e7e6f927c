"""Connected components of a graph given by its edges, by alternating star operations.

Both operations keep connectivity: the large star links the larger neighbours
of a node to its smallest one, the small star links a node and its smaller
neighbours to the smallest.  When neither changes anything, every node hangs
on the smallest of its component.  Edges stay in a table between rounds; the
driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger to the smaller node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of each node that has an edge; ``edges`` has columns ``a`` and ``b`` of one ordered type."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    seen = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)).where("a <> b").distinct(), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
