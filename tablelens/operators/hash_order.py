"""The first rows of a table in the order of a hash, without sorting the table.

A limit is found from the counts of hash buckets; only the distinct hashes of
the one bucket that holds it are ordered.  Rows that share the hash at the
limit are told apart by a hash of the whole row in the same way.  Where the
limit falls among equal rows they are counted and written out again, some on
either side: which of them does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..session import materialize

# Top bits of the hash; a stratum is cut into this many buckets to find its limit.
BUCKET_BITS = 16
# Up to this many strata the table of limits is broadcast, beyond it is joined.
BROADCAST_STRATA = 10_000
# Equal rows that one task writes out at a time.
COPIES_AT_ONCE = 100_000


def key_hash(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[ref(c) for c in key])


def _bucket(h: Column) -> Column:
    """Top bits of the hash as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS)


def _limits(hashed: DataFrame, quota: DataFrame) -> DataFrame:
    """Per stratum the hash that its ``quota``-th row has, the rows with that hash, and how many of them are wanted.

    ``hashed`` has ``stratum`` and ``h``, ``quota`` has ``q`` (the stratum) and ``quota``.
    """
    hashed = hashed.withColumn("bucket", _bucket(F.col("h")))
    upward = Window.partitionBy("stratum").orderBy("bucket")
    reached = (
        hashed.groupBy("stratum", "bucket").count()
        .withColumn("upto", F.sum("count").over(upward))
        .withColumn("before", F.col("upto") - F.col("count"))
        .join(quota, F.col("stratum").eqNullSafe(F.col("q")))
        .where((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("upto")))
        .select(F.col("stratum").alias("s"), F.col("bucket").alias("b"), (F.col("quota") - F.col("before")).alias("place"))
    )
    inside = hashed.join(reached, F.col("stratum").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    order = Window.partitionBy("stratum").orderBy("h")
    return (
        inside.groupBy("stratum", "h", "place").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("upto", F.sum("copies").over(order))
        .withColumn("wanted", F.col("place") - F.col("upto") + F.col("copies"))
        .where((F.col("wanted") > 0) & (F.col("place") <= F.col("upto")))
        .select("stratum", "h", "wanted", "copies")
    )


def _below(h: Column, limit: Column) -> Column:
    return (_bucket(h) < _bucket(limit)) | ((_bucket(h) == _bucket(limit)) & (h < limit))


def _at_limits(df: DataFrame, limits: DataFrame, stratum: Column | None) -> DataFrame:
    """The rows with the limits of their stratum as further columns."""
    if stratum is None:
        row = limits.first()
        return df.select("*", *[F.lit(row[c] if row else None).cast(t).alias(c) for c, t in limits.dtypes])
    few = limits.count() <= BROADCAST_STRATA
    return df.join(F.broadcast(limits) if few else limits, stratum.eqNullSafe(F.col("__stratum")), "left")


def mark_first(
    df: DataFrame, quota: DataFrame, name: str, key: Sequence[str], seed: int, stratum: Column | None = None, together: bool = False
) -> DataFrame:
    """Add the flag ``name``: true for exactly ``quota`` rows of each stratum, the first by the hash of ``key``.

    ``quota`` has the columns ``q`` (0 without strata) and ``quota``.  With
    ``together`` all rows with the key at the limit are in, even if that
    makes more rows.
    """
    of = F.lit(0) if stratum is None else stratum
    h, whole = key_hash(key, seed), key_hash(df.columns, seed + 1)
    first = _limits(df.select(of.alias("stratum"), h.alias("h")), quota)
    first = materialize(first.select(F.col("stratum").alias("__stratum"), F.col("h").alias("__h"), "wanted", "copies"), "limits")
    undecided = first.where("wanted < copies")
    if together or undecided.isEmpty():
        marked = _at_limits(df, first.drop("wanted", "copies"), stratum)
        flag = F.coalesce(_below(h, F.col("__h")) | (h == F.col("__h")), F.lit(False))
        return marked.select(*[ref(c) for c in df.columns], flag.alias(name))

    at = _at_limits(df, undecided.select("__stratum", "__h"), stratum).where(h == F.col("__h"))
    second = _limits(
        at.select(of.alias("stratum"), whole.alias("h")), undecided.select(F.col("__stratum").alias("q"), F.col("wanted").alias("quota"))
    )
    second = second.select(
        F.col("stratum").alias("__s"), F.col("h").alias("__row"), F.col("wanted").alias("__wanted"),
        (F.col("wanted") < F.col("copies")).alias("__shared"),
    )
    both = materialize(
        first.drop("wanted", "copies").join(second, F.col("__stratum").eqNullSafe(F.col("__s")), "left").drop("__s"), "limits"
    )
    r = F.col("__row")
    flag = (
        F.when(F.col("__h").isNull(), False)
        .when(h != F.col("__h"), _below(h, F.col("__h")))
        .when(r.isNull(), True)
        .when(whole != r, _below(whole, r))
        .when(~F.col("__shared"), True)
    )
    columns = [ref(c) for c in df.columns]
    marked = _at_limits(df, both, stratum).select(*columns, flag.alias(name), "__wanted")
    equal = with_copy_number(marked.where(ref(name).isNull()).select(*columns, "__wanted"), "__copy")
    shared = equal.select(*columns, (F.col("__copy") < F.col("__wanted")).alias(name))
    return marked.where(ref(name).isNotNull()).drop("__wanted").unionByName(shared)


def with_copy_number(df: DataFrame, name: str) -> DataFrame:
    """Number equal rows from 0; they are counted before the shuffle and written out again by many tasks."""
    counted = df.groupBy(*[ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    last = F.floor((F.col("__copies") - 1) / COPIES_AT_ONCE)
    blocks = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("__block"))
    large = blocks.where(F.col("__copies") > COPIES_AT_ONCE).repartition("__block")
    begin = F.col("__block") * COPIES_AT_ONCE
    end = F.least(begin + COPIES_AT_ONCE, F.col("__copies")) - 1
    return (
        blocks.where(F.col("__copies") <= COPIES_AT_ONCE).unionByName(large)
        .select(*[ref(c) for c in df.columns], F.explode(F.sequence(begin, end)).alias(name))
    )
