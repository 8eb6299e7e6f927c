"""Long repeats: run-length indexes over the corpus, streamed for matches of at least ``length`` bytes.

A byte is removed if a string of ``length`` bytes that covers it also starts
anywhere else, in the same document or another one.

1. Windows (all strings of ``length`` bytes of a document) are dealt out by
   content.  The leftmost of the 32-byte strings with the least hash in a
   window is its anchor; consecutive windows with one anchor form a segment.
   Equal windows have equal anchors, so windows with different anchors need
   never be compared, and each window lies in exactly one segment.
2. Anchors that occur once in the corpus are dropped: their windows are unique.
   Of the others, segments are counted by digest.  A segment that occurs twice
   is a repeat as a whole.  Anchors with one distinct segment are done.
3. What is left are the places where copies begin, end or differ.  Those
   segments, grouped by anchor, are indexed in blocks of whole groups: suffix
   order, Burrows-Wheeler transform, its runs, and the sampled positions at
   the run heads.  The length that a suffix shares with its neighbour falls by
   one per step within a run, so it is compared at run heads only and streamed
   from there over the text: the matching statistics of the block with itself.
   Positions with a match of ``length`` or more mark their windows.
4. An anchor with more than ``hot`` distinct segments (a passage in very many
   contexts) does not fit a block; its windows are counted by a 128-bit
   digest in a grouped aggregation instead, which finds the same repeats.

Copies of a document are one text with a count.  Null is the empty text.  An
empty table gives an empty one.  Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, map_batches, materialize, parallelism, utf8

LENGTH = 200
GRAM = 32
HOT = 20_000
# Bytes that a task hashes, and that one index holds (a group of up to ``hot`` segments may be more).
CHUNK = 2_000_000
BLOCK = 2_000_000
# Behind a text stand a separator and the text's number to the base 7, all bytes that no UTF-8 text holds.
SEPARATOR, DIGIT, DIGITS = 0xFF, 0xF8, 8

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MULTIPLIERS[4]
    h ^= h >> np.uint64(29)
    size = 1
    for m in _MULTIPLIERS:
        h = h[:-size] * m + h[size:]
        h ^= h >> np.uint64(31)
        size *= 2
    h *= _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(32))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def segments_of(buffer: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows and numbers of windows of the segments of texts laid end to end, their anchors' hashes and texts.

    ``ends``: where the texts end.
    """
    data = np.frombuffer(buffer, np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none
    h = _grams(data)
    low = np.uint64(0xFFFFFFFF)
    least = _sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    window = np.arange(len(anchor))
    text = np.searchsorted(ends, window, side="right")
    inside = window + length <= ends[np.minimum(text, len(ends) - 1)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1
    return first, stop - first, h[anchor[first]], text[first]


_SEGMENT = "key binary, start long, windows int, anchor long, segment long"


def anchored(texts: DataFrame, length: int) -> DataFrame:
    """(key, start, windows, anchor, segment) of all segments of (key, raw); anchor and segment are hashes of contents."""

    def emit(buffer: bytes, ends: list[int], keys: list[bytes], offsets: list[int]) -> pa.RecordBatch:
        first, n, anchor, text = segments_of(buffer, np.array(ends), length)
        digest, stop = xxhash.xxh64_intdigest, (first + n + length - 1).tolist()
        segment = np.fromiter((digest(buffer[a:b]) for a, b in zip(first.tolist(), stop, strict=True)), np.uint64, len(first))
        begins = np.array([0, *ends[:-1]])
        start = first - begins[text] + np.array(offsets)[text]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[t] for t in text.tolist()], pa.binary()), pa.array(start, pa.int64()), pa.array(n.astype(np.int32)),
                pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)),
            ],
            ["key", "start", "windows", "anchor", "segment"],
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, ends, keys, offsets, held = [], [], [], [], 0
        for key, raw in zip(batch.column(0), batch.column(1), strict=True):
            key, raw = key.as_py(), raw.as_py()
            if len(raw) < length:
                continue
            for lo in range(0, len(raw) - length + 1, CHUNK):  # a long text in parts that share all but a window
                piece = raw[lo : lo + CHUNK + length - 1]
                parts.append(piece)
                held += len(piece)
                ends.append(held)
                keys.append(key)
                offsets.append(lo)
                if held >= CHUNK:
                    yield emit(b"".join(parts), ends, keys, offsets)
                    parts, ends, keys, offsets, held = [], [], [], [], 0
        if parts:
            yield emit(b"".join(parts), ends, keys, offsets)

    return map_batches(texts.select("key", "raw"), run, _SEGMENT)


# --- the index ----------------------------------------------------------------------------------


def _end(number: int) -> bytes:
    return bytes([SEPARATOR, *(DIGIT + number // 7**k % 7 for k in range(DIGITS))])


class RunLengthIndex:
    """Suffix order and run-length Burrows-Wheeler transform of texts that are joined by separators.

    Behind each text stand a separator and its number, so that no two suffixes
    are equal for longer than a text and a separator, and no match of a text
    reaches over its end.  ``down`` holds the positions of the suffixes at run
    heads and how many bytes each shares with the suffix before it, ``up``
    those at run ends and what they share with the suffix behind.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"".join(t + _end(k) for k, t in enumerate(texts))
        self.data = data = np.frombuffer(joined, np.uint8)
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        packed = np.zeros(n, np.uint64)
        for k in range(8):
            packed = (packed << np.uint64(8)) | padded[k : k + n]
        order = np.argsort(packed)
        rank = self._ranks(packed, order)
        self.levels, size = [(8, rank)], 8
        while rank[order[-1]] < n - 1:
            key = rank.astype(np.int64) * (n + 1)
            key[:-size] += rank[size:] + 1
            order = np.argsort(key)
            rank = self._ranks(key, order)
            size *= 2
            self.levels.append((size, rank))
        previous = np.where(order > 0, data[order - 1].astype(np.int16), -1)  # what precedes the first byte is like nothing else
        head = np.ones(n, bool)
        head[1:] = previous[1:] != previous[:-1]
        rows = np.flatnonzero(head)
        tail = np.flatnonzero(np.append(head[1:], True))
        self.runs = len(rows)
        # Samples: run heads with the suffix before them, run ends with the suffix after them.
        # The first suffix has none before it, the last none after it: they share nothing.
        self.down = self._sampled(order[rows], np.where(rows > 0, order[rows - 1], n))
        self.up = self._sampled(order[tail], np.append(order[tail[:-1] + 1], n))

    @staticmethod
    def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        s = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        return rank

    def _sampled(self, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions, and the bytes that each shares with its neighbour in suffix order."""
        n, a, b = len(self.data), here.copy(), there.copy()
        total = np.zeros(len(here), np.int64)
        for size, rank in reversed(self.levels):
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            total[same] += size
            a[same] += size
            b[same] += size
        for _ in range(8):
            same = (a < n) & (b < n) & (self.data[np.minimum(a, n - 1)] == self.data[np.minimum(b, n - 1)])
            total[same] += 1
            a = np.where(same, a + 1, n)
            b = np.where(same, b + 1, n)
        return here, total

    def matching(self) -> np.ndarray:
        """For each position the longest match with another position, streamed from the samples."""
        n, best = len(self.data), np.zeros(len(self.data), np.int64)
        for here, shared in (self.down, self.up):
            value = np.zeros(n, np.int64)
            sampled = np.zeros(n, np.int64)
            value[here] = shared
            sampled[here] = here
            last = np.maximum.accumulate(sampled)
            best = np.maximum(best, value[last] - (np.arange(n) - last))
        return best


def repeated_windows(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text the runs (begin, end) of its bytes in windows that occur at another place in the texts."""
    index = RunLengthIndex(texts)
    match = index.matching()
    out, at = [], 0
    for t in texts:
        starts = np.flatnonzero(match[at : at + max(0, len(t) - length + 1)] >= length)
        at += len(t) + 1 + DIGITS
        out.append(_covered(starts, length))
    return out


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Union of [s, s + length) for ascending starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    begin = starts[np.concatenate([[0], gap + 1])]
    end = starts[np.concatenate([gap, [len(starts) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist(), strict=True))


_SPANS = "anchor long, segment long, spans array<struct<begin:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _compared(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of repeats of (anchor, segment, raw), rows with all segments of an anchor in one partition."""
    placed = pieces.repartition(parallelism(pieces), "anchor").sortWithinPartitions("anchor", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def solved() -> pa.RecordBatch:
            spans = repeated_windows([r for *_, r in held], length)
            rows = [(a, s, x) for (a, s, _), x in zip(held, spans, strict=True) if x]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([[{"begin": b, "end": e} for b, e in r[2]] for r in rows], _ARROW_SPANS),
                ],
                ["anchor", "segment", "spans"],
            )

        for batch in batches:
            for a, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0], held[-1][1]) == (a, s):
                    continue  # fetched from two copies of a text
                if size >= BLOCK and held[-1][0] != a:
                    yield solved()
                    held, size = [], 0
                held.append((a, s, raw))
                size += len(raw)
        if held:
            yield solved()

    return placed.mapInArrow(run, _SPANS)


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments: windows are counted by digest."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(len(raw) - length + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a] * len(w), pa.int64()), pa.array([s] * len(w), pa.int64()), pa.array(range(len(w)), pa.int32()), pa.array(w, pa.binary())],
                ["anchor", "segment", "at", "window"],
            )

    windows = map_batches(pieces.dropDuplicates(["anchor", "segment"]), run, "anchor long, segment long, at int, window binary")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    span = F.struct(F.col("at").alias("begin"), (F.col("at") + length).cast("int").alias("end"))
    return windows.join(twice, "window").groupBy("anchor", "segment").agg(F.collect_list(span).alias("spans"))


# --- documents ----------------------------------------------------------------------------------


def repeats(texts: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(key, spans) of the texts (key, raw) with repeats; spans may overlap.  A key stands for one content."""
    found = materialize(anchored(texts, length), "segments-found")
    total = found.count()
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-anchors")
    places = join_counted(found, shared, ["anchor"], total).groupBy("key", "start", "windows", "anchor", "segment").agg(F.count(F.lit(1)).alias("n"))
    places = materialize(places, "places")
    kinds = places.groupBy("anchor", "segment").agg(
        F.sum("n").alias("n"), F.max("windows").alias("windows"), F.min(F.struct("key", "start")).alias("at")
    )
    kinds = materialize(kinds, "segments")
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum("n").alias("n"))
    open_anchors = materialize(per_anchor.where("kinds > 1 AND least = 1").select("anchor", (F.col("kinds") > hot).alias("hot"), "n"), "open-anchors")
    wanted = (
        join_counted(kinds.drop("n"), open_anchors, ["anchor"], total)
        .groupBy(F.col("at.key").alias("key"))
        .agg(F.collect_list(F.struct(F.col("at.start").alias("start"), "windows", "anchor", "segment", "hot")).alias("wanted"))
    )
    wanted = materialize(wanted, "wanted-segments")
    cut = (
        texts.join(wanted, "key")
        .select("raw", F.explode("wanted").alias("w"))
        .select("w.anchor", "w.segment", F.substring("raw", F.col("w.start").cast("int") + 1, F.col("w.windows") + length - 1).alias("raw"), "w.hot")
    )
    cut = materialize(cut, "cut")
    whole = kinds.where("n > 1").select(
        "anchor", "segment", "n", F.array(F.struct(F.lit(0).alias("begin"), (F.col("windows") + length - 1).cast("int").alias("end"))).alias("spans")
    )
    pieces = cut.where("NOT hot").select("anchor", "segment", "raw")
    parts = _compared(pieces, length)
    if not cut.where("hot").isEmpty():
        parts = parts.union(_counted(cut.where("hot").select("anchor", "segment", "raw"), length))
    single = kinds.where("n = 1").select("anchor", "segment", "n")
    spans = materialize(whole.union(parts.join(single, ["anchor", "segment"]).select("anchor", "segment", "n", "spans")), "segment-spans")
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["begin"]).alias("begin"), (F.col("start") + s["end"]).alias("end")))
    return (
        join_counted(places.drop("n"), spans, ["anchor", "segment"], total)
        .select("key", moved.alias("spans"))
        .groupBy("key")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


_CUT = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def remove(docs: DataFrame, into: str, text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` with ``into``: struct of n_bytes, n_removed, n_spans and kept, the bytes that remain."""
    raw = utf8(F.col(f"`{text_col}`"))
    key = F.unhex(F.md5(raw))
    k, k2, s = (fresh(docs, name) for name in ("text_key", "repeat_key", "repeat_spans"))
    found = repeats(docs.select(key.alias("key"), raw.alias("raw")), length, hot)
    found = materialize(found.select(F.col("key").alias(k2), F.col("spans").alias(s)), "repeated-bytes")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, spans in batches:
            out = []
            for r, s in zip(raws, spans, strict=True):
                r, s = r.as_py(), s.as_py()
                kept, at, removed, runs, last = [], 0, 0, 0, -1
                for x in sorted((y["begin"], y["end"]) for y in s or ()):
                    begin, end = max(x[0], at), x[1]
                    if end <= at:
                        continue
                    kept.append(r[at:begin])
                    runs += begin > last
                    removed += end - begin
                    at = last = end
                out.append({"n_removed": removed, "n_spans": runs, "kept": b"".join([*kept, r[at:]])})
            yield pa.array(out, _CUT)

    cutter = F.arrow_udf(cut, "struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    joined = docs.withColumn(k, key).join(found, F.col(k) == F.col(k2), "left")
    return joined.withColumn(into, cutter(raw, F.col(s))).select(*[F.col(f"`{c}`") for c in docs.columns if c != into], into)


def report(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per document: bytes, removed bytes and runs, and the digest of what remains."""
    rows = remove(docs.select("doc_id", "text"), "cut", "text", length, hot)
    return rows.select(
        "doc_id",
        F.octet_length(utf8(F.col("text"))).cast("bigint").alias("n_bytes"),
        F.col("cut")["n_removed"].alias("n_removed"),
        F.col("cut")["n_spans"].alias("n_spans"),
        F.sha2(F.col("cut")["kept"], 256).alias("kept_sha256"),
    )
