"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize as _materialize
from ..session import scratch_path
from ..sources.files import remove

__all__ = ["bound_batches", "fresh", "join_counted", "materialize", "map_batches", "parallelism", "passing", "read", "scratch_path", "utf8"]


# Bytes of the Arrow batches that tasks exchange with Python, whatever the length of the texts.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES``, unless the session asks for smaller ones."""
    if not 0 < _bytes(spark.conf.get(_BATCH_SETTING)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    digits = setting.lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(digits[-1:], 0)
    return int(digits[:-1] if unit else digits) << unit


# The tables of each open ``passing``, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, shuffle files as soon as the query that wrote them is done.

    Nothing that outlives the block may read these tables: what is needed later is stored with ``stays``.
    """
    tables: list[str] = []
    outer = _passing.set((*_passing.get(), tables))
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
        _passing.reset(outer)
        for path in tables:
            remove(spark, path)


def materialize(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """``df`` as a stored table; with ``stays`` it outlives the innermost ``passing``, if not those around it."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    scopes = _passing.get()[:-1] if stays else _passing.get()
    if scopes:
        scopes[-1].append(path)
    return _materialize(df, label, path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(text: Column) -> Column:
    """The bytes of a text; of null none."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def parallelism(df: DataFrame) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """Apply ``fn`` to Arrow batches; memory is bounded by a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


# A key with more than one of so many parts of the rows is joined by broadcast.
HOT_KEYS = 1_000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined to ``table``, whose ``n`` tells at least how many rows have its key.

    Keys with more than a ``HOT_KEYS``-th of all rows, of which there are fewer
    than that, are broadcast; so no task of the shuffle holds one of them.
    """
    hot = F.broadcast(table.where(F.col("n") * HOT_KEYS > total))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col("n") * HOT_KEYS <= total), keys)
    return rows.join(hot, keys).unionByName(cold)
