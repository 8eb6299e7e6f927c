"""SimHash near-duplicates by anchor-point covering.

Anchors are the words of the perfect Hamming code of length 31: every 31-bit
value is within one bit of exactly one of them, so the covering radius is 1.
A fingerprint has two such fields (bits 0-30 and 31-61; the last two bits are
only compared).  Of at most three differing bits at most one lies in one of
the fields, hence in that field

    distance to the anchor of the other  <=  covering radius + 1.

Each distinct fingerprint is therefore replicated, per field, to every anchor
within distance 2 (16 of them, or one if it is an anchor itself), and within
an anchor each fingerprint whose own anchor it is (its home) is compared with
all that are there.  No pair within the threshold is missed.

Equal fingerprints are one before that, whatever the number of documents.
Within an anchor the links are reduced to a spanning forest, so a dense group
of n fingerprints sends on n - 1 links, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, parallelism, utf8
from .components import components

SEED = 42
THRESHOLD = 3
FIELD = 31
# Groups up to this size are compared at once, larger ones in rows against all.
AT_ONCE = 512


# --- fingerprints -------------------------------------------------------------------------------


def fingerprint(raw: bytes, shingle: int) -> int:
    """Bit i is set if it is in more than half of the hashes of the word shingles (repeats count)."""
    words = raw.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    else:
        joined = b" ".join(words)
        begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=begin[1:])
        begin = begin.tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a : b - 1], SEED) for a, b in zip(begin, begin[shingle:], strict=False)], "<u8"
        )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the 64-bit hashes; of none, none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, into: str, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``df`` with the fingerprint of a text as a signed long (null: as a text without words)."""

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for raws in batches:
            values = np.fromiter((fingerprint(r.as_py(), shingle) for r in raws), np.uint64, len(raws))
            yield pa.array(values.view(np.int64))

    return df.withColumn(into, F.arrow_udf(prints, "long")(utf8(F.col(f"`{text_col}`"))))


# --- links --------------------------------------------------------------------------------------


def _field(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, FIELD * k).bitwiseAND(F.lit((1 << FIELD) - 1))


def _syndrome(value: Column) -> Column:
    """Exclusive-or of the numbers (1 to 31) of the bits that are set; 0 at an anchor."""
    out = F.lit(0)
    for j in range(5):
        mask = sum(1 << (n - 1) for n in range(1, FIELD + 1) if n >> j & 1)
        out = out + F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(mask))) % 2, j)
    return out


def _bit(n: Column) -> Column:
    """The value with bit number ``n`` set, 0 for number 0."""
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), n - 1))


def anchors(value: Column) -> tuple[Column, Column]:
    """The anchor next to a 31-bit value, and all anchors within distance 2 of it."""
    s = _syndrome(value)
    home = value.bitwiseXOR(_bit(s))
    pairs = F.filter(F.sequence(F.lit(0), F.lit(FIELD)), lambda j: j < j.bitwiseXOR(s))
    near = F.transform(pairs, lambda j: value.bitwiseXOR(_bit(j)).bitwiseXOR(_bit(j.bitwiseXOR(s))))
    return home, F.when(s == 0, F.array(value)).otherwise(near)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that span the components of one anchor's fingerprints.

    Homes are compared with all.  Two that are both away from home need no
    comparison here: they meet at the home of either.
    """
    fps = np.concatenate([fps[home], fps[~home]])
    n = int(home.sum())
    label = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    step = max(1, AT_ONCE * AT_ONCE // max(1, len(fps)))
    for lo in range(0, n, step):
        rows = fps[lo : min(n, lo + step)]
        close = _distance(rows[:, None], fps[None, :]) <= threshold
        for r in np.flatnonzero(close.sum(axis=1) > 1):
            near = np.flatnonzero(close[r])
            other = np.unique(label[near], return_index=True)
            if len(other[0]) > 1:
                me = label[lo + r]
                for part, k in zip(other[0], near[other[1]], strict=True):
                    if part != me:
                        links.append((int(fps[lo + r]), int(fps[k])))
                        label[label == part] = me
    return links


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly what the threshold connects."""
    if threshold > 3:
        raise ValueError("two fields of radius 1 cover three differing bits at most")
    fields = []
    for k in range(2):
        home, near = anchors(_field(F.col("fp"), k))
        fields.append(F.struct(F.lit(k).alias("field"), home.alias("home"), near.alias("near")))
    spread = (
        prints.withColumn("f", F.explode(F.array(*fields)))
        .select("fp", "f.field", "f.home", F.explode("f.near").alias("anchor"))
        .select((F.col("anchor") * 2 + F.col("field")).alias("place"), (F.col("anchor") == F.col("home")).alias("home"), "fp")
        .repartition(parallelism(prints), "place")
        .sortWithinPartitions("place")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, home, fps = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

        def met(last: bool) -> tuple[pa.RecordBatch, int]:
            edge = np.flatnonzero(np.diff(place)) + 1
            begin = np.concatenate([[0], edge])
            end = np.concatenate([edge, [len(place)]])
            if not last:
                begin, end = begin[:-1], end[:-1]
            homes = np.concatenate([[0], np.cumsum(home)])
            busy = (end - begin > 1) & (homes[end] > homes[begin])
            found = [x for b, e in zip(begin[busy], end[busy], strict=True) for x in forest(fps[b:e], home[b:e], threshold)]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"]), int(end[-1]) if len(end) else 0

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.concatenate([place, batch.column(0).to_numpy()])
            home = np.concatenate([home, batch.column(1).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(2).to_numpy()])
            if place[0] != place[-1]:
                out, done = met(False)
                place, home, fps = place[done:], home[done:], fps[done:]
                yield out
        if len(place):
            yield met(True)[0]

    return spread.mapInArrow(run, "a long, b long").distinct()


# --- documents ----------------------------------------------------------------------------------


def groups(prints: DataFrame, first: Column, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, first): for each fingerprint the least value of ``first`` among all rows of its component."""
    one = materialize(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct-fingerprints")
    roots = components(links(one, threshold)).withColumnRenamed("node", "fp")
    linked = one.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    found = linked.join(least, "root").select("fp", "least")
    return one.join(found, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))


def report(docs: DataFrame, shingle: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document.

    A null text is a text without words.  A component whose ids are all null
    has the id null.  Repeated rows are linked like any others.
    """
    prints = with_fingerprint(docs.select("doc_id", "text"), "fp", "text", shingle).select("doc_id", "fp")
    prints = materialize(prints, "fingerprints")
    found = groups(prints, F.col("doc_id"), threshold)
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, null last, any one of repeated rows."""
    row = fresh(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    texts = numbered.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(row).alias("row"))
    prints = materialize(with_fingerprint(texts, "fp", "text", shingle).select("fp", "id", "row"), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    found = groups(prints, first, threshold)
    dropped = prints.join(found, "fp").where(F.col("row") != F.col("first")["row"]).select(F.col("row").alias(row))
    return numbered.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
