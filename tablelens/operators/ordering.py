"""Order-dependent work over a whole table without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_missing, ref, require_columns, value_of
from ..session import materialize

BLOCK = "__block"


def ordered_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition the table and number the ranges in key order.

    The number is written with the rows, so every later reader (and every
    retried task) sees the same blocks.  Callers first reduce to one row per
    key: blocks then stay even however often a key occurs.
    """
    ranged = df.repartitionByRange(*[ref(c) for c in order])
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def running_totals(df: DataFrame, order: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add, for each row, the sums over all rows with smaller keys.

    One row per key is expected.  Sums inside a block come from a window on the
    block, those of earlier blocks from a table with one row per block.
    """
    blocks = ordered_blocks(df, order)
    per_block = blocks.groupBy(BLOCK).agg(*[F.sum(e).alias(n) for n, e in totals.items()])
    # One row per block: bounded by the number of shuffle partitions.
    earlier = Window.partitionBy(F.lit(0)).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        BLOCK, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__before_{n}") for n in totals]
    )
    within = (
        Window.partitionBy(BLOCK).orderBy(*[ref(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    )
    return blocks.join(F.broadcast(offsets), BLOCK).select(
        *df.columns,
        *[
            (F.coalesce(F.sum(e).over(within), F.lit(0)) + F.col(f"__before_{n}")).alias(n)
            for n, e in totals.items()
        ],
    )


def fill_along(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] | None = None,
    forward: bool = True,
) -> DataFrame:
    """Carry the nearest value in row order into missing cells.

    Rows follow ``order_by``; among rows with equal keys the missing ones come
    last (first when filling backward) and the others by value.  The fill
    therefore depends on one value per key, so a key held by a third of the
    rows shrinks to one row before anything is ordered.  The keys are ordered
    in blocks, each block takes over the last value of the earlier blocks, and
    only the rows with a missing cell are joined back to their key's value.
    """
    parts = list(partition_by or [])
    keys = parts + list(order_by)
    require_columns(df, [column, *keys])
    if column in keys:
        raise ValueError("the filled column cannot order its own rows")
    value = value_of(df, column)
    best = F.max(value) if forward else F.min(value)
    per_key = df.groupBy(*[ref(k) for k in keys]).agg(
        best.alias("__anchor"), F.max(is_missing(df, column)).alias("__has_gap")
    )
    blocks = ordered_blocks(per_key, keys)

    order = [ref(k).asc() if forward else ref(k).desc() for k in order_by]
    block_order = F.col(BLOCK).asc() if forward else F.col(BLOCK).desc()
    part_cols = [ref(p) for p in parts]
    anchored = F.when(
        F.col("__anchor").isNotNull(), F.struct(*[ref(k) for k in order_by], F.col("__anchor"))
    )
    last_anchor = (F.max(anchored) if forward else F.min(anchored))["__anchor"]
    per_block = blocks.groupBy(BLOCK, *part_cols).agg(last_anchor.alias("__last"))
    # At most one row per block within a part.
    earlier = (
        Window.partitionBy(*(part_cols or [F.lit(0)])).orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_block.select(
        F.col(BLOCK).alias("__carry_block"),
        *[p.alias(f"__carry_{i}") for i, p in enumerate(part_cols)],
        F.last("__last", ignorenulls=True).over(earlier).alias("__carry"),
    ).where(F.col("__carry").isNotNull())
    same = F.col(BLOCK) == F.col("__carry_block")
    for i, p in enumerate(part_cols):
        same = same & p.eqNullSafe(F.col(f"__carry_{i}"))
    if parts:
        # Only the part at the edge of a block can continue from another block.
        names = [f"__edge_{i}" for i in range(len(parts))]
        packed = F.struct(*[p.alias(n) for p, n in zip(part_cols, names)])
        edge = (F.min(packed) if forward else F.max(packed)).alias("__edge")
        edges = blocks.groupBy(F.col(BLOCK).alias("__edge_block")).agg(edge).select("__edge_block", "__edge.*")
        on_edge = F.col("__carry_block") == F.col("__edge_block")
        for i, n in enumerate(names):
            on_edge = on_edge & F.col(f"__carry_{i}").eqNullSafe(F.col(n))
        carry = carry.join(F.broadcast(edges), on_edge, "left_semi")

    within = Window.partitionBy(BLOCK, *part_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fills = (
        blocks.withColumn("__near", F.last("__anchor", ignorenulls=True).over(within))
        .where("__has_gap")
        # At most one row per block, and there are no more blocks than shuffle partitions.
        .join(F.broadcast(carry), same, "left")
        .select(
            *[ref(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
            F.coalesce("__near", "__carry").alias("__fill"),
        )
        .where(F.col("__fill").isNotNull())
    )
    gaps = df.where(is_missing(df, column))
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & ref(k).eqNullSafe(F.col(f"__key_{i}"))
    filled = gaps.join(fills, match, "left").select(
        *[F.col("__fill").alias(c) if c == column else ref(c) for c in df.columns]
    )
    return df.where(~is_missing(df, column)).unionByName(filled)
