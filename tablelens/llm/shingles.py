"""Near copies: SimHash anchors and prefixes propose pairs, exact Jaccard similarity of word shingles decides.

Two texts are linked if the sets of their shingles (five words) have a Jaccard
similarity of at least ``least`` (0.8).  Pairs are proposed in two rounds.

1. Fingerprints of the shingles are covered by anchors (``simhash.links``):
   texts of equal or close fingerprints are proposed along one link each, so a
   dense group of n copies costs about n comparisons.
2. Fingerprints alone would miss pairs, the prefixes of the sets do not: in any
   order of all shingles, the sets of a pair share one of their first
   n - ceil(least n) + 1.  The order puts the most frequent shingles last;
   which these are is counted about, as it decides on speed alone.  Each text
   is proposed with the hub (one per shingle and size) that it meets most often.
3. Proposed pairs are confirmed on their whole sets and joined to components.
   In a few more rounds each text is proposed with a hub of another component.
   Of all texts that meet in prefix shingles, those that are still in different
   components, and that sizes and the number of shared prefix shingles do not
   rule out, are proposed in a last round and confirmed in the same way.

A shingle in the prefixes of very many texts is divided into blocks of bounded
size, each pair of blocks a group of its own.

Words are those of ``simhash.fingerprint``.  A text of fewer words than a
shingle is one shingle; texts without words (null too) are equal.  Equal words
(a 128-bit digest tells) are one text before all that, whatever the number of
documents.  An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, parallelism, passing, utf8
from .components import components
from .simhash import SEED, THRESHOLD, links, majority

SIZE, LEAST = 5, 0.8
# Shingles that a task counts, and that are ordered by their counts.
LISTED, FREQUENT = 1 << 15, 1 << 20
# Texts of one shingle that are compared in one group, and rows of a shingle that a task holds.
BLOCK, HELD = 5_000, 1 << 20
# Rounds in which components are compared by hubs, before all pairs that are still open.
HUB_ROUNDS = 6
# Texts that one task compares with a text.
TOGETHER = 2_000
# Bits of the filter that keeps texts that nobody asks for in their place: 2 MB.
FILTER_BITS = 1 << 24
# Guards products of sizes and ``least`` against rounding.
TINY = 1e-9


def hashes(raw: bytes, size: int = SIZE) -> np.ndarray:
    """The hashes of the word shingles of a text, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        found = [digest(joined, SEED)]
    else:
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=begin[1:])
        begin = begin.tolist()
        found = [digest(joined[a : b - 1], SEED) for a, b in zip(begin, begin[size:], strict=False)]
    return np.array(found, np.uint64).view(np.int64)


def shingles(raw: bytes, size: int = SIZE) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, in order."""
    return np.unique(hashes(raw, size))


def text_key(raw: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(raw.lower().split()), SEED)


def text_name(key: bytes) -> int:
    """The short name under which a text is proposed; the few texts that may share one are all looked at."""
    return int.from_bytes(key[:8], "big", signed=True)


class Frequent:
    """The shingles of the most texts, about: rare ones may be forgotten on the way, which costs time, not pairs."""

    def __init__(self) -> None:
        self.count: dict[int, int] = {}

    def add(self, sets: list[np.ndarray]) -> None:
        if not sets:
            return
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        for k, c in zip(h[n > 1].tolist(), n[n > 1].tolist(), strict=True):
            self.count[k] = self.count.get(k, 0) + c
        if len(self.count) > 8 * LISTED:
            self.count = dict(self.most(4 * LISTED))

    def most(self, n: int) -> list[tuple[int, int]]:
        return sorted(self.count.items(), key=lambda x: (-x[1], x[0]))[:n]


def read_texts(numbered: DataFrame, size: int) -> DataFrame:
    """(row, key, fp) of each of (row, raw), and (h, n) of the frequent shingles of a task."""
    names = ["row", "key", "fp", "h", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, seen = Frequent(), {}
        for batch in batches:
            rows, keys, prints, sets = batch.column(0), [], [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                key = text_key(raw)
                if key not in seen:
                    found = hashes(raw, size)
                    seen[key] = majority(found)
                    sets.append(np.unique(found))
                keys.append(key)
                prints.append(seen[key])
            frequent.add(sets)
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([rows, pa.array(keys, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), none, none], names)
        h, n = zip(*frequent.most(LISTED), strict=True) if frequent.count else ((), ())
        none = pa.nulls(len(h), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(len(h), pa.binary()), none, pa.array(h, pa.int64()), pa.array(n, pa.int64())], names)

    return numbered.mapInArrow(run, "row long, key binary, fp long, h long, n long")


def frequent_shingles(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, ascending, and counts of the ``most`` shingles of the most texts."""
    counted = found.where("h IS NOT NULL").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most).toArrow().sort_by("h")
    return counted["h"].to_numpy(), counted["n"].to_numpy()


def _counts(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, n = frequent
    if not len(known):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return np.where(known[at] == s, n[at], 0)


def prefixes(raws: DataFrame, frequent: tuple[np.ndarray, np.ndarray], size: int, least: float) -> DataFrame:
    """(h, name, n): the prefix shingles of each text, once per task, and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            h, names, n = [], [], []
            for raw in batch.column(0):
                raw = raw.as_py()
                key = text_key(raw)
                if key in seen:
                    continue
                seen.add(key)
                s = shingles(raw, size)
                s = s[np.argsort(_counts(s, frequent), kind="stable")]
                h.append(s[: len(s) - math.ceil(least * len(s) - TINY) + 1])
                names.append(text_name(key))
                n.append(len(s))
            if not h:
                continue
            sizes = [len(x) for x in h]
            arrays = [np.concatenate(h), np.repeat(np.array(names, np.int64), sizes), np.repeat(np.array(n, np.int32), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["h", "name", "n"])

    return raws.mapInArrow(run, "h long, name long, n int")


def _by_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of the rows in runs of whole groups; rows come in order of their first column.

    Of a group above ``HELD`` rows parts are given out, each with the last row of the one before.
    """
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or (held and held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [x[:cut] for x in now], strict=True)]
            held, size = [], 0
        held.append([x[cut:] for x in now])
        size += len(now[0]) - cut
        if size > HELD:
            part = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield part
            held, size = [[x[-1:] for x in part]], 1
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _enough(shared_ones: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can be similar if their prefixes share so many.

    Of the set whose prefix ends first in the order, no shingle behind the
    prefix counts more than once, and all shared ones before are in both prefixes.
    """
    wanted = F.ceil(F.lit(least / (1 + least)) * (n + m) - TINY)
    behind = F.ceil(F.lit(least) * F.greatest(n, m) - TINY) - 1
    return shared_ones >= wanted - behind


def shared(rows: DataFrame, least: float) -> DataFrame:
    """(h, name, n, hub, hub_n) of the shingles of two or more texts; the hub is the text to compare with, if there is one.

    Texts of a shingle come in order of size, and a hub serves those that are not too large for it.
    """
    ordered = rows.repartition(parallelism(rows), "h").sortWithinPartitions("h", "n", "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, name, n in _by_shingle(batches):
            first = np.ones(len(h), bool)  # copies of a text are one
            first[1:] = (h[1:] != h[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
            h, name, n = h[first], name[first], n[first]
            edge = np.append(True, h[1:] != h[:-1])
            alone = edge & np.append(edge[1:], True)
            h, name, n, edge = h[~alone], name[~alone], n[~alone], edge[~alone]
            hub = np.empty(len(h), np.int64)
            place = 0
            for k, (new, size) in enumerate(zip(edge.tolist(), n.tolist(), strict=True)):
                if new or (k != place and limit < size):
                    place, limit = k, size / least + TINY
                hub[k] = place
            own = hub == np.arange(len(h))
            arrays = [pa.array(h), pa.array(name), pa.array(n), pa.array(name[hub], mask=own), pa.array(n[hub], mask=own)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "name", "n", "hub", "hub_n"])

    return ordered.mapInArrow(run, "h long, name long, n int, hub long, hub_n int")


def _across(name: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, n, m) of the pairs of a group, in order of size, of like sizes and in different components (and blocks, if there are two)."""
    kinds, kind, sizes = np.unique(root, return_inverse=True, return_counts=True)
    small = kind != np.argmax(sizes)  # at least one text of each pair is not in the largest component
    two = (side != side[0]).any()
    lo = np.searchsorted(n, least * n - TINY)
    hi = np.searchsorted(n, n / least + TINY, side="right")
    for i in np.flatnonzero(small).tolist():
        rest = np.arange(lo[i], hi[i])
        near = (kind[rest] != kind[i]) & (~small[rest] | (rest > i))
        if two:
            near &= side[rest] != side[i]
        rest = rest[near]
        if len(rest):
            yield np.full(len(rest), name[i]), name[rest], np.full(len(rest), n[i]), n[rest]


def _in_cells(met: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(cell, name, n, root, side) of the texts that meet, in order of cell and size; ``roots``: (name, root).

    A cell is a shingle, or a pair of blocks (sides) of one of very many texts.
    """
    rows = met.drop("hub", "hub_n").join(roots, "name")
    sizes = materialize(met.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > block), "frequent-shingles")
    blocks = F.ceil(F.col("texts") / block).cast("int")
    side = F.pmod(F.xxhash64("name"), blocks).cast("int")
    cell = lambda j: F.xxhash64("h", F.least("side", j), F.greatest("side", j))
    cells = F.when(F.col("texts").isNull(), F.array("h")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell))
    rows = rows.join(sizes, "h", "left").withColumn("side", F.coalesce(side, F.lit(0))).withColumn("blocks", blocks)
    rows = rows.select(F.explode(cells).alias("cell"), "name", "n", "root", "side")
    return rows.repartition(parallelism(rows), "cell").sortWithinPartitions("cell", "n")


def _mixed_groups(h: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last row of the groups that hold several components."""
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    end = np.append(begin[1:], len(h))
    turn = np.append(0, np.cumsum((root[1:] != root[:-1]) & (h[1:] == h[:-1])))
    mixed = turn[end - 1] > turn[begin]
    return zip(begin[mixed].tolist(), end[mixed].tolist(), strict=True)


def other_hubs(met: DataFrame, roots: DataFrame, least: float, turn: int, block: int = BLOCK) -> DataFrame:
    """(a, b): each text b with a text of another component, of those that it meets the one that shares most of its prefix.

    Of each group one text of each of its two largest components is a hub, so
    components of near copies grow together without all their pairs.  Which one
    changes from ``turn`` to turn, and is the same wherever the texts meet.
    """
    mixer = 0x9E3779B97F4A7C15
    start = (turn + 1) * mixer % (1 << 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, name, n, root, _ in _by_shingle(batches):
            found = []
            order = (name.view(np.uint64) ^ np.uint64(start)) * np.uint64(mixer)
            order ^= order >> np.uint64(31)
            for lo, hi in _mixed_groups(h, root):
                _, kind, sizes = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
                one, two = (np.flatnonzero(kind == k) for k in np.argsort(-sizes, kind="stable")[:2])
                first, second = (members[np.argmin(order[lo:hi][members])] for members in (one, two))
                hub = np.full(hi - lo, lo + first)
                hub[one] = lo + second
                found.append((name[hub], name[lo:hi], n[hub], n[lo:hi]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "n", "m"])

    found = _in_cells(met, roots, block).mapInArrow(run, "a long, b long, n int, m int")
    counted = found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.max("n").alias("n"), F.max("m").alias("m"))
    fits = (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - TINY) & _enough(F.col("both"), F.col("n"), F.col("m"), least)
    best = counted.where(fits).groupBy("b").agg(F.max(F.struct("both", "a")).alias("best"))
    return best.select(F.col("best.a").alias("a"), "b")


def open_pairs(met: DataFrame, roots: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): names of texts in different components that share enough of their prefixes; ``roots``: (name, root)."""
    ordered = _in_cells(met, roots, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["a", "b", "n", "m"])

        for h, name, n, root, side in _by_shingle(batches):
            found, held = [], 0
            for lo, hi in _mixed_groups(h, root):
                for pairs in _across(name[lo:hi], n[lo:hi], root[lo:hi], side[lo:hi], least):
                    found.append(pairs)
                    held += len(pairs[0])
                    if held > 1 << 18:
                        yield batch_of(found)
                        found, held = [], 0
            if found:
                yield batch_of(found)

    found = ordered.mapInArrow(run, "a long, b long, n int, m int")
    counted = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.max(F.greatest("n", "m")).alias("n"), F.max(F.least("n", "m")).alias("m"))
    return counted.where(_enough(F.col("both"), F.col("n"), F.col("m"), least)).select("a", "b")


def _maybe_in(wanted: DataFrame) -> Callable[[str], Column]:
    """A test that all rows of ``wanted`` pass, and few others while these are fewer than ``FILTER_BITS``, so that other texts need not move."""
    bit = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    word, mask = F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    words = wanted.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy()
    packed = bits.tobytes()

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = np.frombuffer(packed, np.int64)
        for places in batches:
            at = places.to_numpy()
            yield pa.array(known[at >> 6] >> (at & 63) & 1 > 0)

    hit = F.arrow_udf(test, "boolean")
    return lambda c: hit(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)))


def confirmed(pairs: DataFrame, one: DataFrame, texts: DataFrame, size: int, least: float, most: int = TOGETHER) -> DataFrame:
    """The pairs (a, b) of names whose sets are similar, as rows; ``one``: (name, row) of each text, ``texts``: (row, raw).

    The texts ``b`` go to their ``a`` and are compared with it one by one.  A
    text of more than ``most`` pairs goes to several tasks.
    """
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tasks"))
    hubs = tasks.select(F.col("a").alias("name"), "a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("side"))
    others = pairs.join(tasks, "a").select(F.col("b").alias("name"), "a", F.pmod("b", "tasks").cast("int").alias("task"), F.lit(1).alias("side"))
    wanted = materialize(hubs.union(others).join(one, "name").select("row", F.xxhash64("a", "task").alias("place"), "a", "side"), "wanted-texts")
    placed = texts.where(_maybe_in(wanted)("row")).join(wanted, "row").select("place", "a", "side", "row", "raw")
    placed = placed.repartition(parallelism(texts), "place").sortWithinPartitions("place", "a", "side", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hubs = None, []
        for batch in batches:
            found = []
            for place, a, side, row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (place, a) != now:
                    now, hubs = (place, a), []
                s = shingles(raw, size)
                if not side:
                    hubs.append((row, s))
                    continue
                for other, h in hubs:
                    if min(len(s), len(h)) < least * max(len(s), len(h)) - TINY:
                        continue
                    both = len(np.intersect1d(s, h, assume_unique=True))
                    if both >= least * (len(s) + len(h) - both) - TINY:
                        found.append((other, row))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return placed.mapInArrow(run, "a long, b long").distinct()


def _first_proposals(one: DataFrame, met: DataFrame, least: float, threshold: int) -> DataFrame:
    """(a, b): texts of equal or close fingerprints, along a forest, and each text with the hub that it meets most often."""
    prints = materialize(one.groupBy("fp").agg(F.min("name").alias("name")), "distinct-fingerprints")
    same = one.select("fp", F.col("name").alias("b")).join(prints.withColumnRenamed("name", "a"), "fp").where("a <> b").select("a", "b")
    near = links(prints.select("fp"), threshold)
    for c in "ab":
        near = near.join(prints.select(F.col("fp").alias(c), F.col("name").alias(f"name_{c}")), c)
    # One link of each text, to the smallest of its neighbours: as many pairs as texts, however dense a group is.
    near = near.groupBy(F.greatest("name_a", "name_b").alias("b")).agg(F.min(F.least("name_a", "name_b")).alias("a")).select("a", "b")
    often = met.where("hub IS NOT NULL").groupBy("name", "hub").agg(F.count(F.lit(1)).alias("both"), F.max("n").alias("n"), F.max("hub_n").alias("m"))
    often = often.where(_enough(F.col("both"), F.col("n"), F.col("m"), least))
    best = often.groupBy("name").agg(F.max(F.struct("both", "hub")).alias("best")).select(F.col("name").alias("a"), F.col("best.hub").alias("b"))
    both = same.union(near).union(best.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    # Each pair once, from its hub.
    ends = [F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")]
    once = both.groupBy(*ends).agg(F.min("a").alias("a"))
    return once.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, threshold: int = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, null last, any one of repeated rows."""
    row = fresh(docs, "row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with passing(docs.sparkSession):
        texts = numbered.select(F.col(row).alias("row"), utf8(F.col(f"`{text_col}`")).alias("raw"))
        ids = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"))
        dropped = materialize(_copies(texts, ids, size, least, threshold, block).withColumnRenamed("row", row), "dropped-rows", stays=True)
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _copies(texts: DataFrame, ids: DataFrame, size: int, least: float, threshold: int, block: int) -> DataFrame:
    """The rows that are not the first of their component, of (row, raw) and (row, id)."""
    spark = texts.sparkSession
    found = materialize(read_texts(texts, size), "text-prints")
    keyed = found.where("row IS NOT NULL").select("row", "key", "fp").join(ids, "row")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    one = keyed.groupBy("key").agg(F.min(first).alias("first"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("copies"))
    name = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    one = materialize(one.select("key", "first", "fp", "copies", name.alias("name"), F.col("first")["row"].alias("node")), "distinct-texts")
    names = one.select("name", F.col("node").alias("row"))

    met = materialize(shared(prefixes(texts.select("raw"), frequent_shingles(found, FREQUENT), size, least), least), "shared-shingles")
    with passing(spark):
        tried = materialize(_first_proposals(one, met, least, threshold), "first-pairs", stays=True)

    def linked(pairs: DataFrame, label: str) -> DataFrame:
        with passing(spark):
            return materialize(confirmed(pairs, names, texts, size, least), label, stays=True)

    def joined(links_: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The components as links to their roots, and (name, root) of all texts."""
        with passing(spark):
            stars = materialize(components(links_).select(F.col("node").alias("a"), F.col("root").alias("b")), "stars", stays=True)
        roots = one.join(stars, F.col("node") == F.col("a"), "left").groupBy("name").agg(F.min(F.coalesce("b", "node")).alias("root"))
        return stars, materialize(roots, "text-roots")

    stars, known = joined(linked(tried, "first-links"))
    for turn in range(HUB_ROUNDS):
        with passing(spark):
            more = materialize(other_hubs(met, known, least, turn, block).join(tried, ["a", "b"], "left_anti"), "hub-pairs", stays=True)
        if more.isEmpty():
            break
        tried = tried.union(more)
        stars, known = joined(stars.union(linked(more, "hub-links")))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with passing(spark):
        left = materialize(open_pairs(met, known, least, block).join(done, ["a", "b"], "left_anti"), "open-pairs", stays=True)
    confirmed_links = stars.union(linked(left, "last-links"))

    linked_texts = one.join(components(confirmed_links), "node")
    kept = linked_texts.groupBy("root").agg(F.min("first").alias("kept"))
    stays = materialize(one.join(linked_texts.join(kept, "root").select("key", "kept"), "key", "left").select("key", F.coalesce("kept", "first").alias("kept")), "kept-texts")
    return keyed.join(stays, "key").where(F.col("row") != F.col("kept")["row"]).select("row")
