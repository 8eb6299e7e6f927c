"""Repeated passages: windows of ``length`` words that start at more than one place of the corpus.

1. Windows are dealt out by content.  The leftmost of the word strings
   (``gram`` words) with the least hash in a window is its anchor; consecutive
   windows with one anchor form a piece.  Equal windows have equal anchors, so
   a piece whose anchor occurs once in the corpus holds no repeated window.
2. The other pieces are collapsed to kinds (equal words) with counts.  A kind
   that occurs twice is a recurring phrase as a whole.  Windows of kinds that
   occur once are counted by digest over the kinds of their anchor; those of
   two kinds are recurring phrases too.
3. Phrases are dealt into shards by anchor and compiled into one Aho-Corasick
   automaton per shard, whose letters are words.  The pieces of all documents
   stream through the automaton of their shard, which finds every place of
   every phrase.  An anchor with many phrases has several automata, one with
   many kinds several tasks; each bounds memory and changes no result.
4. The places go back to the documents and their words are removed.

Copies of a text are one text with a count.  Null and texts without words have
no windows.  An empty table gives an empty one.  Repeated rows are copies of
each other.  A text of any length is cut in parts that share all but a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_counted, map_batches, materialize, parallelism, utf8

LENGTH = 35
GRAM = 8
# Bytes of words that a task hashes together.
CHUNK = 1_000_000
# Windows that one automaton is compiled from, and kinds that one task streams of an anchor.
PHRASES, PIECES = 20_000, 20_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Hashes:
    """Hashes of ranges of bytes by prefix sums; equal bytes have equal hashes wherever they lie."""

    bytes_ = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
    power = inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(_Hashes.power) <= len(data):
            size = 1 << len(data).bit_length()
            _Hashes.power = _powers(_MULTIPLIER, size)
            _Hashes.inverse = _powers(pow(_MULTIPLIER, -1, 1 << 64), size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes_[data] * self.power[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def pieces_of(words: list[bytes], ends: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """First words, numbers of windows, anchors, texts and digests of the pieces of texts laid end to end.

    ``ends``: where the texts end, in words.
    """
    n = len(words)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, []
    buffer = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    h = _Hashes(np.frombuffer(buffer, np.uint8)).of(begin[: n - gram + 1], end[gram - 1 :])
    low = np.uint64(0xFFFFFFFF)
    at = (_sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    stops = np.array(ends)
    text = np.searchsorted(stops, np.arange(len(at)), side="right")
    inside = np.arange(len(at)) + length <= stops[text]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    windows = np.flatnonzero(np.append(new[1:] | ~inside[1:], True) & inside) + 1 - first
    digest = xxhash.xxh3_128_digest
    digests = [digest(buffer[a:b]) for a, b in zip(begin[first].tolist(), end[first + windows + length - 2].tolist(), strict=True)]
    return first, windows, h[at[first]].view(np.int64), text[first], digests


_PIECE = "key binary, start long, windows int, anchor long, piece binary"


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, start, windows, anchor, piece) of all pieces of (key, raw); anchor and piece are hashes of words."""

    def emit(words: list[bytes], ends: list[int], keys: list[bytes], offsets: list[int]) -> pa.RecordBatch:
        first, windows, anchor, text, digests = pieces_of(words, ends, length, gram)
        start = first - np.array([0, *ends[:-1]])[text] + np.array(offsets)[text]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([keys[t] for t in text.tolist()], pa.binary()), pa.array(start, pa.int64()), pa.array(windows.astype(np.int32)),
                pa.array(anchor, pa.int64()), pa.array(digests, pa.binary()),
            ],
            ["key", "start", "windows", "anchor", "piece"],
        )

    part = max(CHUNK // 8, length)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, ends, keys, offsets, held = [], [], [], [], 0
        for key, raw in zip(batch.column(0), batch.column(1), strict=True):
            key, found = key.as_py(), raw.as_py().split()
            for lo in range(0, len(found) - length + 1, part):
                here = found[lo : lo + part + length - 1]
                words += here
                held += sum(map(len, here)) + len(here)
                ends.append(len(words))
                keys.append(key)
                offsets.append(lo)
                if held >= CHUNK:
                    yield emit(words, ends, keys, offsets)
                    words, ends, keys, offsets, held = [], [], [], [], 0
        if words:
            yield emit(words, ends, keys, offsets)

    return map_batches(texts.select("key", "raw"), run, _PIECE)


def _cut_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(kind, raw): the words of the pieces that ``wanted`` lists per key, joined by one space; now and then twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for key, raw, pieces in zip(*batch.columns, strict=True):
                if key.as_py() == last:
                    continue  # a copy of the text before
                last, words, pieces = key.as_py(), raw.as_py().split(), pieces.as_py()
                cut = [b" ".join(words[p["start"] : p["start"] + p["windows"] + length - 1]) for p in pieces]
                yield pa.RecordBatch.from_arrays([pa.array([p["kind"] for p in pieces], pa.int64()), pa.array(cut, pa.binary())], ["kind", "raw"])

    return texts.join(wanted, "key").select("key", "raw", "pieces").mapInArrow(run, "kind long, raw binary")


def _windows(pieces: DataFrame, length: int) -> DataFrame:
    """(window, kind, at, once): digests of all windows of (kind, n, raw); ``at`` counts from the first word."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for part in (batch.slice(k, 2_000) for k in range(0, batch.num_rows, 2_000)):
            window, kind, at, once = [], [], [], []
            for k, n, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                raw = raw.as_py()
                ends = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), len(raw)).tolist()
                begins = [0, *(e + 1 for e in ends[:-1])]
                found = [digest(raw[a:b]) for a, b in zip(begins, ends[length - 1 :], strict=False)]
                window += found
                kind += repeat(k, len(found))
                at += range(len(found))
                once += repeat(n == 1, len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(window, pa.binary()), pa.array(kind, pa.int64()), pa.array(at, pa.int32()), pa.array(once, pa.bool_())], ["window", "kind", "at", "once"]
            )

    return map_batches(pieces.select("kind", "n", "raw"), run, "window binary, kind long, at int, once boolean")


def _phrases(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, raw, whole): recurring phrases; each window of ``length`` words of one that is not ``whole`` is a phrase."""
    shared = (
        _windows(pieces.where("open"), length)
        .groupBy("window")
        .agg(F.min("kind").alias("kind"), F.max("kind").alias("last"), F.min_by("at", "kind").alias("at"), F.max("once").alias("once"))
        .where("once AND kind <> last")
    )
    marked = materialize(shared.groupBy("kind").agg(F.sort_array(F.collect_list("at")).alias("at")), "shared-windows")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        anchors, runs = [], []
        for anchor, raw, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            words, at = raw.as_py().split(), np.array(at.as_py())
            cut = np.flatnonzero(np.diff(at) > 1)
            for lo, hi in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist(), strict=True):
                anchors.append(anchor)
                runs.append(b" ".join(words[lo : hi + length]))
        yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(runs, pa.binary())], ["anchor", "raw"])

    parts = map_batches(pieces.join(marked, "kind").select("anchor", "raw", "at"), run, "anchor long, raw binary")
    whole = pieces.where("n > 1").select("anchor", "raw", F.lit(True).alias("whole"))
    return whole.union(parts.select("anchor", "raw", F.lit(False).alias("whole")))


class Automaton:
    """Aho-Corasick automaton over words: phrases are added, then texts stream through it."""

    def __init__(self) -> None:
        self.letters: dict[bytes, int] = {}
        self.built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)

    def add(self, words: list[bytes], length: int) -> None:
        """All strings of ``length`` words of these."""
        letters = self.letters
        spelled = tuple([letters.setdefault(w, len(letters) + 1) for w in words])
        for k in range(len(spelled) - length + 1):
            self.built.add_word(spelled[k : k + length])

    def close(self) -> None:
        self.built.make_automaton()

    def places(self, words: list[bytes]) -> list[dict[str, int]]:
        """Union of the places of all phrases: runs of words as begin and end."""
        if self.built.kind != ahocorasick.AHOCORASICK:
            return []
        out: list[dict[str, int]] = []
        for last, size in self.built.iter(tuple(map(self.letters.get, words, repeat(0)))):
            begin, end = last + 1 - size, last + 1
            while out and out[-1]["end"] >= begin:
                begin = min(begin, out.pop()["begin"])
            out.append({"begin": begin, "end": end})
        return out


_PLACES = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def located(phrases: DataFrame, pieces: DataFrame, n_shards: int, length: int, most_phrases: int, most_pieces: int) -> DataFrame:
    """(kind, spans): every place of a phrase in the pieces; ``kinds`` and ``load`` count those, and the windows, of an anchor."""
    sized = pieces.select("anchor", F.ceil(F.col("load") / most_phrases).cast("int").alias("parts"), F.ceil(F.col("kinds") / most_pieces).cast("int").alias("tasks"), "kind", "raw")
    grid = sized.where("parts > 1 OR tasks > 1").groupBy("anchor").agg(F.first("parts").alias("parts"), F.first("tasks").alias("tasks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    compiled = (
        phrases.join(materialize(grid, "divided-anchors"), "anchor", "left").na.fill(1, ["parts", "tasks"])
        .withColumn("part", F.pmod(F.xxhash64("raw"), F.col("parts")).cast("int"))
        .withColumn("task", upto("tasks"))
        .select("anchor", "part", "task", F.lit(None).cast("long").alias("kind"), "raw", "whole")
    )
    streamed = (
        sized.withColumn("task", F.pmod("kind", F.col("tasks")).cast("int"))
        .withColumn("part", upto("parts"))
        .select("anchor", "part", "task", "kind", "raw", F.lit(None).cast("boolean").alias("whole"))
    )
    shard = F.pmod(F.xxhash64("anchor"), F.lit(n_shards))
    rows = compiled.union(streamed).withColumn("shard", F.xxhash64(shard, "part", "task")).select("shard", "kind", "raw", "whole")
    placed = rows.repartition(parallelism(rows), "shard").sortWithinPartitions("shard", F.col("kind").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, open_ = None, Automaton(), False
        for batch in batches:
            kinds, spans = [], []
            for place, kind, raw, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if place != now:
                    now, automaton, open_ = place, Automaton(), True
                words = raw.as_py().split()
                if kind is None:
                    automaton.add(words, len(words) if whole else length)
                    continue
                if open_:
                    automaton.close()
                    open_ = False
                found = automaton.places(words)
                if found:
                    kinds.append(kind)
                    spans.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(spans, _PLACES)], ["kind", "spans"])

    return placed.mapInArrow(run, "kind long, spans array<struct<begin:int,end:int>>")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most_phrases: int = PHRASES, most_pieces: int = PIECES) -> DataFrame:
    """(key, spans) of the texts (key, raw) with repeats, in words; spans may overlap.  A key stands for one content."""
    found = materialize(anchored(texts, length, gram), "phrase-pieces")
    total = found.count()
    shared = materialize(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-anchors")
    places = join_counted(found, shared, ["anchor"], total).groupBy("key", "start", "windows", "anchor", "piece").agg(F.count(F.lit(1)).alias("n"))
    places = materialize(places, "phrase-places")
    kinds = places.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.max("windows").alias("windows"), F.min(F.struct("key", "start")).alias("at"))
    kinds = materialize(kinds.withColumn("kind", F.monotonically_increasing_id()), "phrase-kinds")
    per_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"), F.sum("windows").alias("load"), F.sum("n").alias("n"))
    per_anchor = materialize(per_anchor, "phrase-anchors")
    sized = join_counted(kinds.withColumnRenamed("n", "times"), per_anchor, ["anchor"], total)
    sized = sized.select("kind", "anchor", F.col("times").alias("n"), "kinds", "load", F.expr("kinds > 1 AND least = 1").alias("open"))
    wanted = kinds.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("kind", F.col("at.start").alias("start"), "windows")).alias("pieces"))
    pieces = materialize(sized.join(_cut_out(texts, materialize(wanted, "wanted-pieces"), length), "kind"), "piece-words")
    phrases = materialize(_phrases(pieces, length), "phrases")
    windows = kinds.agg(F.sum("windows")).first()[0] or 0
    hits = located(phrases, pieces, max(1, math.ceil(windows / most_phrases)), length, most_phrases, most_pieces)
    hits = materialize(hits, "phrase-hits")
    spans = materialize(kinds.join(hits, "kind").select("anchor", "piece", "n", "spans"), "piece-spans")
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["begin"]).alias("begin"), (F.col("start") + s["end"]).alias("end")))
    back = join_counted(places.drop("n"), spans, ["anchor", "piece"], total)
    return back.select("key", moved.alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_CUT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def remove(
    docs: DataFrame, into: str, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most_phrases: int = PHRASES, most_pieces: int = PIECES
) -> DataFrame:
    """``docs`` with ``into``: struct of n_words, n_removed and kept, the words that remain joined by one space."""
    raw = utf8(F.col(f"`{text_col}`"))
    key = F.unhex(F.md5(raw))
    k, k2, s = (fresh(docs, name) for name in ("text_key", "repeat_key", "repeat_spans"))
    found = repeats(docs.select(key.alias("key"), raw.alias("raw")), length, gram, most_phrases, most_pieces)
    found = materialize(found.select(F.col("key").alias(k2), F.col("spans").alias(s)), "repeated-passages")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, spans in batches:
            out = []
            for raw, marked in zip(raws, spans, strict=True):
                words, kept, at, gone = raw.as_py().split(), [], 0, 0
                for begin, end in sorted((x["begin"], x["end"]) for x in marked.as_py() or ()):
                    kept += words[at:begin]
                    gone += max(0, end - max(begin, at))
                    at = max(at, end)
                kept += words[at:]
                out.append({"n_words": len(words), "n_removed": gone, "kept": b" ".join(kept)})
            yield pa.array(out, _CUT)

    cutter = F.arrow_udf(cut, "struct<n_words:bigint,n_removed:bigint,kept:binary>")
    joined = docs.withColumn(k, key).join(found, F.col(k) == F.col(k2), "left")
    return joined.withColumn(into, cutter(raw, F.col(s))).select(*[F.col(f"`{c}`") for c in docs.columns if c != into], into)


def report(docs: DataFrame, **settings: int) -> DataFrame:
    """One row per document: words, removed words, and the digest of what remains."""
    rows = remove(docs.select("doc_id", "text"), "cut", "text", **settings)
    return rows.select(
        "doc_id", F.col("cut")["n_words"].alias("n_words"), F.col("cut")["n_removed"].alias("n_removed"), F.sha2(F.col("cut")["kept"], 256).alias("kept_sha256")
    )
