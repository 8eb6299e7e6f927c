"""Exact, repeatable train/test split and folds by key hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ref, require_columns
from ..operators.hash_order import key_hash, mark_first, with_copy_number


def _quotas(df: DataFrame, test: float, stratum: Column) -> DataFrame:
    """``ceil(test * n)`` rows shared out to the strata by largest remainder."""
    sizes = df.select(stratum.alias("q")).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).scalar()
    wanted = F.ceil(total * F.lit(test))
    share = F.col("n") * wanted / total
    base = sizes.select("q", share.alias("share"), F.floor(share).alias("base"), wanted.alias("wanted"))
    left = F.col("wanted") - base.agg(F.sum("base")).scalar()
    # One row per stratum.
    by_remainder = Window.partitionBy(F.lit(0)).orderBy((F.col("share") - F.col("base")).desc(), "q")
    return base.select("q", (F.col("base") + (F.row_number().over(by_remainder) <= left).cast("int")).alias("quota"))


def mark_test(
    df: DataFrame, test: float = 0.2, seed: int = 42, stratify: str | None = None, key: Sequence[str] | None = None,
    group_key: bool = False,
) -> DataFrame:
    """Add ``is_test``; exactly ``ceil(test * n)`` rows are true, in proportion per class.

    Rows are chosen by the hash of ``key``, which should identify a row; rows
    that share the key at the limit are told apart by all their columns.  With
    ``group_key`` they stay together instead, and there may be more test rows.
    """
    key = list(key or df.columns)
    require_columns(df, key + ([stratify] if stratify else []))
    quota = _quotas(df, test, ref(stratify) if stratify else F.lit(0))
    return mark_first(df, quota, "is_test", key, seed, ref(stratify) if stratify else None, group_key)


def split(
    df: DataFrame, test: float = 0.2, seed: int = 42, stratify: str | None = None, key: Sequence[str] | None = None,
    group_key: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows."""
    marked = mark_test(df, test, seed, stratify, key, group_key)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def with_folds(df: DataFrame, folds: int = 3, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Add ``fold``: from the hash of the key, or without a key such that equal rows go round the folds."""
    if key:
        return df.withColumn("fold", F.pmod(key_hash(list(key), seed + 1), F.lit(folds)).cast("int"))
    fold = F.pmod(F.pmod(key_hash(df.columns, seed + 1), F.lit(folds)) + F.col("__copy"), F.lit(folds)).cast("int")
    return with_copy_number(df, "__copy").select(*[ref(c) for c in df.columns], fold.alias("fold"))
