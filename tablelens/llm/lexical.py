"""Ranked lexical search: impact vectors in buckets of equal length, pruned by bounds, rescored in integers.

Terms are the maximal runs of letters, digits and characters beyond ASCII; only
A-Z are lower-cased.  N counts the documents with a term, L all their terms, n
one document's terms, df the documents that hold a term, tf its occurrences in
the document.  A term weighs  w = floor(1000 ln((2N + 2) / (2 df + 1)));  a
document's impact on it is  x = 10^9 tf div (1000 tf + 12 m)  with
m = 75 + (25 n N) div L.  The score of an item sums  w x  over its terms,
repeats included.

1. One pass over the whole texts turns documents into sparse vectors over the
   items' terms, which are stored; N, L and df follow from these.
2. Impacts w x are vectors, and items are vectors of how often they hold a
   term.  Documents are ordered by the length of their vector and dealt into
   buckets of about equal length.
3. A bucket whose longest vector times the item's length is below the item's
   k-th score is skipped (Cauchy-Schwarz).  In the others only the item's
   leading terms are summed up, until the rest, by the largest impacts in the
   bucket, cannot reach the k-th score alone.  A document stays if what it has
   plus the lesser of two bounds on its rest, by coordinates and by the length
   of what is left of it, reaches the k-th score.  Documents that stay are
   scored exactly in 64-bit integers.
4. The longest vectors are searched first; their k-th scores are floors for
   all other buckets.  Tasks' lists are merged by rank.

Items are taken in blocks of bounded number, whose terms and scores are what a
task holds besides a bucket.  No join or group is made by term or text, so
frequent terms and copies do not meet in one task.

Null and texts without terms take no part.  Equal scores go to the smaller id,
null last.  Repeated rows are documents, and items, of their own.  An empty
table of either kind gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, scratch_path, utf8

K = 20
ITEMS, BUCKET = 5_000, 4_096
# Share of the documents, those with the longest vectors, that is searched first.
FIRST = 1 / 32

_UPPER = range(0x41, 0x5B)
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_LETTERS = bytes(b + 32 if b in _UPPER else b if b in _KEPT else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_LETTERS).split()


def vectors(docs: DataFrame, place: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of the documents (id, raw) with terms; of these only the ones that have a ``place`` are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, ends, found, counts = [], [], [0], [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms(raw.as_py())
                if not words:
                    continue
                tf = Counter(map(place.get, words))
                tf.pop(None, None)
                ids.append(k)
                n.append(len(words))
                found += tf.keys()
                counts += tf.values()
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (found, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and values of a column of lists."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def impacts(found: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """(id, row, length, terms, impacts) of the documents with a listed term; impacts are w x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row, n = batch.column(0), batch.column(1), batch.column(2).to_numpy()
            size, term = _flat(batch.column(3))
            _, tf = _flat(batch.column(4))
            m = np.array([75 + 25 * x * n_docs // n_terms for x in n.tolist()], np.int64)
            x = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, size)))
            doc = np.repeat(np.arange(len(n)), size)
            length = np.sqrt(np.bincount(doc, x.astype(np.float64) ** 2, minlength=len(n)))
            ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x))
            out = pa.RecordBatch.from_arrays([ids, row, pa.array(length), *lists], ["id", "row", "length", "terms", "impacts"])
            yield out.filter(pa.array(length > 0))

    columns = found.select("id", "row", "n", "terms", "counts")
    return columns.mapInArrow(run, "id long, row long, length double, terms array<int>, impacts array<bigint>")


class Bucket:
    """Documents with about equally long vectors: per term the documents that hold it and their impacts."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.size, self.doc, self.impact = size, doc[order], impact[order]
        listed, begin = np.unique(term[order], return_index=True)
        self.span = dict(zip(listed.tolist(), zip(begin.tolist(), np.append(begin[1:], len(term)).tolist(), strict=True), strict=True))
        self.most = dict(zip(listed.tolist(), np.maximum.reduceat(self.impact, begin).tolist() if len(begin) else [], strict=True))
        self.square = np.bincount(doc, impact.astype(np.float64) ** 2, minlength=size)
        self.longest = math.sqrt(self.square.max(initial=0))

    def search(self, item: list[tuple[int, int]], floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the documents that score at least ``floor``, which is above 0, for the item's (term, count)."""
        none = np.empty(0, np.int64)
        if math.sqrt(sum(c * c for _, c in item)) * self.longest * (1 + 1e-9) < floor:
            return none, none
        here = sorted(((c * self.most[t], t, c) for t, c in item if t in self.most), reverse=True)
        rest = sum(b for b, *_ in here)  # the most that terms not summed up yet can give
        have, seen = np.zeros(self.size, np.int64), np.zeros(self.size)
        lead = 0
        while lead < len(here) and rest >= floor:
            bound, t, c = here[lead]
            lo, hi = self.span[t]
            have[self.doc[lo:hi]] += c * self.impact[lo:hi]
            seen[self.doc[lo:hi]] += self.impact[lo:hi].astype(np.float64) ** 2
            rest -= bound
            lead += 1
        places = np.flatnonzero(have + rest >= max(floor, 1))
        left = math.sqrt(sum(c * c for *_, c in here[lead:])) * np.sqrt(np.maximum(self.square[places] * (1 + 1e-9) - seen[places], 0))
        places = places[have[places] + np.minimum(left * (1 + 1e-9) + 1, rest) >= floor]
        score = have[places]
        for _, t, c in here[lead:]:
            lo, hi = self.span[t]
            at = np.searchsorted(self.doc[lo:hi], places)
            at[at == hi - lo] = 0
            score += np.where(self.doc[lo:hi][at] == places, c * self.impact[lo:hi][at], 0)
        good = score >= max(floor, 1)
        return places[good], score[good]


class Best:
    """The k best (score, id) of each item: higher scores first, then smaller ids, null last."""

    def __init__(self, n_items: int, k: int, floors: np.ndarray):
        self.k, self.floor = k, floors.copy()
        empty = np.empty(0, np.int64)
        self.kept = [(empty, empty, np.empty(0, bool))] * n_items

    def add(self, item: int, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        s, i, k = (np.concatenate(pair) for pair in zip(self.kept[item], (score, ids, known), strict=True))
        order = np.lexsort((i, ~k, -s))[: self.k]
        self.kept[item] = s[order], i[order], k[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], s[order[-1]])

    def table(self) -> pa.RecordBatch:
        sizes = [len(s) for s, *_ in self.kept]
        score, ids, known = (np.concatenate([x[c] for x in self.kept]) for c in range(3))
        item = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(ids, mask=~known)], ["item", "score", "id"])


def searched(ordered: DataFrame, items: list[list[tuple[int, int]]], floors: np.ndarray, k: int, bucket: int) -> DataFrame:
    """(item, score, id): the k best of each task for the items, which are lists of (term, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, any_ = Best(len(items), k, floors), False
        for whole in batches:
            for lo in range(0, whole.num_rows, bucket):
                batch = whole.slice(lo, bucket)
                known = np.array(batch.column(0).is_valid())
                ids = batch.column(0).fill_null(_LAST).to_numpy()
                size, term = _flat(batch.column(1))
                _, impact = _flat(batch.column(2))
                here = Bucket(len(ids), np.repeat(np.arange(len(ids)), size), term, impact)
                for number, item in enumerate(items):
                    places, score = here.search(item, max(1, int(best.floor[number])))
                    if len(places):
                        best.add(number, score, ids[places], known[places])
                        any_ = True
        if any_:
            yield best.table()

    return ordered.select("id", "terms", "impacts").mapInArrow(run, "item int, score long, id long")


def _merged(found: DataFrame, k: int) -> DataFrame:
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def rank(
    docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", most_items: int = ITEMS, bucket: int = BUCKET,
) -> DataFrame:
    """(item, rank, document, score), named as the id columns, of each item's k documents with the highest scores above 0."""
    spark = docs.sparkSession
    raws = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), utf8(F.col(f"`{text_col}`")).alias("raw"))
    asked = items.select(F.col(f"`{item_col}`").alias("name"), utf8(F.col(f"`{item_text_col}`")).alias("raw"))
    asked = materialize(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    blocks = math.ceil(asked.count() / most_items)
    out = scratch_path(spark, "ranked-documents")
    schema = f"name {asked.schema['name'].dataType.simpleString()}, rank int, id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        counts = [Counter(terms(raw)) for raw in block["raw"].to_pylist()]
        place = {t: n for n, t in enumerate(sorted(set().union(*counts)))}
        if not place:
            continue
        found = materialize(vectors(raws, place).withColumn("row", F.monotonically_increasing_id()), "term-counts")
        n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weight = np.zeros(len(place), np.int64)
        for t, df in zip(holding["term"].to_pylist(), holding["df"].to_pylist(), strict=True):
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        ordered = impacts(found, weight, n_docs, n_terms).repartitionByRange(parallelism(docs), F.col("length").desc(), "row")
        ordered = materialize(ordered.sortWithinPartitions(F.col("length").desc(), "row"), "length-buckets")
        wanted = [[(place[t], c) for t, c in tf.items()] for tf in counts]
        none = np.zeros(len(wanted), np.int64)
        limit = (ordered.approxQuantile("length", [1 - FIRST], 0.005) or [0.0])[0]
        first = materialize(_merged(searched(ordered.where(F.col("length") >= limit), wanted, none, k, bucket), k), "first-ranks")
        floors = first.where(F.col("rank") == k).select("item", "score").toArrow()
        floor = none.copy()
        floor[floors["item"].to_numpy()] = floors["score"].to_numpy()
        rest = searched(ordered.where(F.col("length") < limit), wanted, floor, k, bucket)
        best = _merged(first.drop("rank").unionByName(rest), k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(wanted)), pa.int32()), "name": block["name"]}))
        best.join(F.broadcast(names), "item").select("name", "rank", "id", "score").write.mode("append").parquet(out)
    best = spark.read.schema(schema).parquet(out)
    return best.select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def report(docs: DataFrame, items: DataFrame, **settings: int) -> DataFrame:
    return rank(docs.select("doc_id", "text"), items.select("item_id", "text"), **settings)
