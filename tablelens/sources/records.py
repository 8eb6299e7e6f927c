"""Records of CSV files whose cells in quotes hold line breaks, read by many tasks.

A line alone does not tell whether it begins inside a quoted cell; that depends
on all lines before it.  But each line, and so each block of a file, maps the
state before it (outside or inside) to the state behind it, and such maps can
be combined in any grouping:

1. Each block's task combines the maps of its lines.
2. The maps of a file's blocks, one row each, are combined in order, which
   gives the state at the beginning of every block.
3. Each block's task joins its lines to records.  What a block leaves open,
   and what it continues, are put together afterwards; these are a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# What a row of assembled text is: a whole record, the continuation or the beginning of one, the first record of a file.
WHOLE, REST, BEGUN, FIRST = range(4)


def without_quoted(record: Column, sep: str) -> Column:
    """The record without the cells in quotes; a quote opens a cell only at its beginning."""
    plain = F.replace(F.regexp_replace(record, "^\\ufeff", ""), F.lit('""'), F.lit(""))
    return F.regexp_replace(plain, f'(?<=^|{sep})"[^"]*"', "")


def left_open(line: Column, sep: str) -> Column:
    """Whether a cell in quotes is open at the end of a line that begins outside of one."""
    return without_quoted(line, sep).rlike(f'(?<=^|{sep})"')


def with_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, out, inside, value): the state behind each line if it begins outside, and if it begins inside a cell.

    ``lines`` come from the text source.  A line that begins inside a cell is
    one that begins with a quote more.
    """
    inside = left_open(F.concat(F.lit('"'), F.col("value")), sep)
    meta = F.col("_metadata")
    return lines.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), left_open(F.col("value"), sep).alias("out"), inside.alias("inside"), "value"
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """(file, block) of a batch with the first and last row of each."""
    n = batch.num_rows
    if not n:
        return
    block = batch.column(1).to_numpy()
    file = np.array(batch.column(0).to_pylist(), object)
    edge = np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1
    for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), n], strict=True):
        yield (file[lo], int(block[lo])), lo, hi


def block_maps(states: DataFrame) -> DataFrame:
    """(file, block, out, inside): the state behind each block for both states before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            out, inside = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            for place, lo, hi in _runs(batch):
                a, b = out[lo:hi], inside[lo:hi]
                fixed = np.flatnonzero(a == b)  # behind such a line the state is known
                at = fixed[-1] + 1 if len(fixed) else 0
                turned = bool(a[at:].sum() % 2)  # the others keep the state or turn it round
                now = [bool(a[at - 1])] * 2 if at else found.get(place, [False, True])
                found[place] = [s != turned for s in now]
        rows = [(f, b, *s) for (f, b), s in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "out", "inside"])

    return states.select("file", "block", "out", "inside").mapInArrow(run, "file string, block long, out boolean, inside boolean")


def block_states(maps: DataFrame) -> DataFrame:
    """(file, block, begins_inside): the blocks' maps combined in order; a file begins outside."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    fixed = F.col("out") == F.col("inside")
    turns = maps.withColumn("turns", F.sum((~fixed & F.col("out")).cast("long")).over(upto))
    last = F.last(F.when(fixed, F.struct(F.col("out").alias("state"), F.col("turns").alias("turns"))), ignorenulls=True).over(before)
    known = turns.select("file", "block", last.alias("last"), F.coalesce(F.last("turns").over(before), F.lit(0)).alias("sofar"))
    turned = (F.col("sofar") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2 == 1
    return known.select("file", "block", (F.coalesce(F.col("last.state"), F.lit(False)) != turned).alias("begins_inside"))


def records(lines: DataFrame, sep: str) -> DataFrame:
    """(file, first, record) of all records that are not blank; ``first``: it is the first of its file."""
    states = with_states(lines, sep)
    begins = materialize(block_states(block_maps(states)), "block-states")
    # One row per block of the files, 128 MB of text each.
    placed = states.join(F.broadcast(begins), ["file", "block"]).select("file", "block", "out", "inside", "begins_inside", "value")
    parts = materialize(_assembled(placed), "csv-records")
    pieces = parts.where(F.col("kind").isin(REST, BEGUN) | (F.col("kind") == FIRST) & F.col("open"))
    order = Window.partitionBy("file").orderBy("block", "place")
    begun = F.max(F.when(F.col("kind") != REST, F.col("block"))).over(order)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "place", "text"))), lambda p: p["text"]), "\n")
    joined = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(F.max((F.col("kind") == FIRST).cast("int")).alias("first"), text.alias("record"))
    whole = parts.where((F.col("kind") == WHOLE) | (F.col("kind") == FIRST) & ~F.col("open"))
    whole = whole.select("file", (F.col("kind") == FIRST).alias("first"), F.col("text").alias("record"))
    return whole.unionByName(joined.select("file", (F.col("first") == 1).alias("first"), "record")).where(F.length(F.trim("record")) > 0)


def _assembled(placed: DataFrame) -> DataFrame:
    """(file, block, place, kind, open, text): the records of each block, and what it continues and leaves open."""
    schema = "file string, block long, place int, kind int, open boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, held, first = None, False, False, [], False
        rows: list[tuple] = []

        def ended(open_: bool) -> None:
            """Writes down the record that is held, if there is one."""
            nonlocal held, first
            if not held:
                return
            blank = len(held) == 1 and not held[0].strip()
            kind = FIRST if first and begun and not blank else REST if not begun else BEGUN if open_ else WHOLE
            first = first and kind != FIRST
            rows.append((*now, 0 if kind == REST else 1, kind, open_, "\n".join(held)))
            held = []

        def batch_of() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "place", "kind", "open", "text"])
            rows.clear()
            return out

        for batch in batches:
            out, inside, begins = (batch.column(c).to_pylist() for c in (2, 3, 4))
            values = batch.column(5).to_pylist()
            for place, lo, hi in _runs(batch):
                if place != now:
                    ended(state)
                    now, state, begun, first = place, begins[lo], not begins[lo], place[1] == 0
                for i in range(lo, hi):
                    if not state and held:
                        ended(False)
                        begun = True
                    held.append(values[i])
                    state = inside[i] if state else out[i]
            yield batch_of()
        ended(state)
        yield batch_of()

    return placed.mapInArrow(run, schema)
