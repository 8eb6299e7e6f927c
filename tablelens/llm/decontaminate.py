"""Benchmark decontamination by a prefix-filtered join of windows.

The windows of a benchmark item are its runs of ``size`` words; an item of
fewer words, but not none, is one window.  A window that occurs whole must
share every word, so its one rarest word is a sufficient prefix: windows are
indexed by the word that is least frequent in all documents, at its offset.
A document word that heads windows proposes starts (positional bound: the
start is not before the text's, length bound: the window ends in the text);
the second rarest word is compared next, and then all words.

The index goes to the tasks (with their functions, which Spark broadcasts) in blocks of at most ``block`` windows, counted
before.  More windows are more passes; each pass adds to the hits of the
earlier ones, so the result does not depend on the block size.

Null texts and ids: a null text has no words.  Repeated documents give
repeated rows, repeated items count once by id, an item without id marks words
but is not listed.  With no items nothing is hit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, materialize, utf8

SIZE = 10
BLOCK = 200_000
# Words and candidates that a task holds as arrays at a time.
WORDS_AT_A_TIME = 1_000_000
CANDIDATES_AT_A_TIME = 500_000

# Letters A-Z become small, what is no digit, letter or non-ASCII byte becomes a space.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (words joined by a space) with the ids of their items."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, raw in zip(ids, texts, strict=True):
            w = words_of(raw)
            grams = dict.fromkeys(b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else {}
            if grams:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(grams), pa.binary()), pa.array([i] * len(grams), pa.string())], ["gram", "item"]
                )

    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), utf8(F.col(f"`{text_col}`")).alias("raw"))
    found = map_batches(rows, run, "gram binary, item string")
    return found.groupBy("gram").agg(F.collect_set("item").alias("items"))


class Index:
    """Windows by their rarest word."""

    def __init__(self, grams: list[list[bytes]], items: list[list[str]], vocabulary: dict[bytes, int], counts: np.ndarray):
        self.vocabulary, self.items = vocabulary, items
        self.length = np.array([len(g) for g in grams], np.int64)
        width = int(self.length.max(initial=1))
        self.words = np.full((len(grams), width), -2, np.int32)
        for k, g in enumerate(grams):
            self.words[k, : len(g)] = [vocabulary[w] for w in g]
        often = np.where(self.words >= 0, counts[self.words], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        self.first, self.second = order[:, 0], np.where(self.length > 1, order[:, min(1, width - 1)], order[:, 0])
        head = self.words[np.arange(len(grams)), self.first]
        self.by_head = np.argsort(head, kind="stable")
        per_word = np.bincount(head, minlength=len(vocabulary))
        self.end = np.cumsum(per_word)
        self.begin = self.end - per_word

    def ids(self, raw: bytes) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words_of(raw)], np.int32)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all occurrences in a sequence of word ids (negative: no benchmark word)."""
        known = np.flatnonzero(text >= 0)
        n = (self.end - self.begin)[text[known]]
        at, n = known[n > 0], n[n > 0]
        starts, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        total = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CANDIDATES_AT_A_TIME)))
            p, m = at[lo:hi], n[lo:hi]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            w = self.by_head[np.repeat(self.begin[text[p]], m) + within]
            s = np.repeat(p, m) - self.first[w]
            ok = (s >= 0) & (s + self.length[w] <= len(text))
            s, w = s[ok], w[ok]
            ok = text[s + self.second[w]] == self.words[w, self.second[w]]
            s, w = s[ok], w[ok]
            for k in range(self.words.shape[1]):
                if not len(s):
                    break
                here = k < self.length[w]
                ok = ~here | (text[np.minimum(s + k, len(text) - 1)] == self.words[w, k])
                s, w = s[ok], w[ok]
            starts.append(s)
            numbers.append(w)
            lo = hi
        return np.concatenate(starts), np.concatenate(numbers)


HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _marked(index: Index, texts: list[np.ndarray], before: list[dict | None]) -> list[dict]:
    """Hits of some documents: their ids are searched as one sequence, with a separator after each."""
    joined = np.concatenate([x for t in texts for x in (t, np.array([-1], np.int32))])
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, numbers = index.occurrences(joined)
    step = np.zeros(len(joined) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + index.length[numbers], -1)
    covered = np.cumsum(step)[:-1] > 0
    doc = np.searchsorted(ends, starts, side="right")
    order = np.argsort(doc, kind="stable")
    doc, numbers = doc[order], numbers[order]
    out = []
    for k, t in enumerate(texts):
        mine = covered[ends[k] - len(t) - 1 : ends[k] - 1]
        names: set[str] = set()
        lo, hi = np.searchsorted(doc, [k, k + 1])
        for w in np.unique(numbers[lo:hi]):
            names.update(x for x in index.items[w] if x is not None)
        if before[k]:
            mine = mine.copy()
            for s in before[k]["spans"]:
                mine[s["start"] : s["end"]] = True
            names.update(before[k]["items"])
        s, e = _runs(mine)
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)]
        out.append({"n_words": len(t), "spans": spans, "items": sorted(names)})
    return out


def _pass(df: DataFrame, index: Index, text_col: str, into: str, again: bool) -> DataFrame:
    def run(batches):
        for raws, earlier in batches:
            before = earlier.to_pylist() if again else [None] * len(raws)
            out, texts, first, held = [], [], 0, 0
            for k in range(len(raws)):
                ids = index.ids(raws[k].as_py())
                texts.append(ids)
                held += len(ids)
                if held > WORDS_AT_A_TIME or k == len(raws) - 1:
                    out += _marked(index, texts, before[first : k + 1])
                    texts, first, held = [], k + 1, 0
            yield pa.array(out, _HITS)

    def marks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)

    mark = F.arrow_udf(marks, HITS)
    earlier = F.col(into) if again else F.lit(None).cast("int")
    return df.withColumn(into, mark(utf8(F.col(f"`{text_col}`")), earlier))


def _counts(docs: DataFrame, text_col: str, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each word of a block's vocabulary occurs in all documents."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        get, total = vocabulary.get, np.zeros(len(vocabulary) + 1, np.int64)
        for raw in batch.column(0):
            total += np.bincount([get(w, -1) + 1 for w in words_of(raw.as_py())], minlength=len(total))
        ids = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[1:][ids], pa.int64())], ["word", "n"])

    rows = map_batches(docs.select(utf8(F.col(f"`{text_col}`")).alias("raw")), run, "word long, n long")
    counts = np.zeros(len(vocabulary), np.int64)
    for word, n in rows.groupBy("word").agg(F.sum("n")).collect():
        counts[word] = n
    return counts


def mark(
    docs: DataFrame,
    items: DataFrame,
    into: str,
    text_col: str = "text",
    size: int = SIZE,
    block: int = BLOCK,
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` with ``into``: number of words, maximal runs of hit words, ids of the items that occur."""
    found = materialize(windows(items, size, item_id, item_text), "windows")
    blocks = max(1, math.ceil(found.count() / block))
    part = F.pmod(F.xxhash64("gram"), F.lit(blocks))
    out = docs
    for b in range(blocks):
        rows = found.where(part == b).collect()  # at most about ``block`` windows
        grams = [bytes(r["gram"]).split(b" ") for r in rows]
        vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for g in grams for w in g))}
        counts = _counts(docs, text_col, vocabulary) if vocabulary else np.zeros(1, np.int64)
        out = _pass(out, Index(grams, [list(r["items"]) or [None] for r in rows], vocabulary, counts), text_col, into, b > 0)
        if blocks > 1:
            out = materialize(out, "hits")
    return out


def report(docs: DataFrame, items: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row per document: words, hit words and the items found."""
    rows = mark(docs.select("doc_id", "text"), items, "hits", "text", size, block).select("doc_id", "hits")
    h = F.col("hits")
    n_hit = F.aggregate(h["spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(h["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(h["items"]), ","), 256).alias("items_sha256"),
        (F.size(h["spans"]) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark."""
    name = fresh(docs, "hits")
    return mark(docs, items, name).where(F.size(F.col(name)["spans"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
