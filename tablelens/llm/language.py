"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its words and the byte strings of one to four bytes,
hashed into ``buckets``.  The mean of their embeddings feeds a linear softmax.
Both are trained by stochastic gradient descent in numpy, on a bounded sample
of labelled rows (``per_language``, a parameter); prediction uses whole texts.
A fifth of the sample stays out of training: on it the temperature of the
softmax is fitted, and the score below which a prediction is rejected, so that
at most ``max_error`` of the accepted ones are wrong.

A text that is null or has no letter is ``und`` with score 0.  Null labels are
never learned.  Without labels every text is ``und``.  Repeated rows get equal
predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

UNKNOWN = "und"
BUCKETS = 1 << 14
DIM = 24
PER_LANGUAGE = 500
EPOCHS, BATCH, RATE = 12, 32, 0.5
MAX_ERROR = 0.01
# Bytes hashed at a time.
CHUNK = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
_POWER = np.cumprod(np.full(CHUNK + 4, 31, np.uint64))


def _hashed(values: np.ndarray, salt: int, buckets: int) -> np.ndarray:
    v = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (v >> np.uint64(40)).astype(np.int64) % buckets


def features(raw: bytes, buckets: int) -> np.ndarray:
    """How often each bucket is hit by the subwords of a text; digits and ASCII symbols are spaces."""
    out = np.zeros(buckets, np.float64)
    folded = b" " + raw.translate(_FOLD) + b" "
    for lo in range(0, len(folded), CHUNK):
        b = np.frombuffer(folded[lo : lo + CHUNK + 3], np.uint8).astype(np.uint64)
        gram = b.copy()
        for size in range(1, 5):
            if size > 1:
                gram = (gram[:-1] << np.uint64(8)) | b[size - 1 :]
            take = gram[: max(0, min(CHUNK, len(folded) - lo - size + 1))]
            if size == 1:
                take = take[take != 32]
            out += np.bincount(_hashed(take, size, buckets), minlength=buckets)
        # Whole words: a sum of their bytes' products with the powers of a multiplier, taken at the spaces and moved to one place.
        space = np.flatnonzero(b == 32)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(b * _POWER[: len(b)])])
        begin, end = space[:-1] + 1, space[1:]
        word = (end > begin) & (end - begin < 16)
        begin, end = begin[word], end[word]
        value = (sums[end] - sums[begin]) * _POWER[CHUNK + 3 - begin] if len(begin) else np.empty(0, np.uint64)
        out += np.bincount(_hashed(value, 99, buckets), minlength=buckets)
    return out


def has_letter(text: str) -> bool:
    return _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
        return (np.sqrt(counts / total) @ self.embedding) @ self.weights + self.bias

    def predict(self, raw: bytes | None) -> tuple[str, float, bool]:
        if raw is None or not self.languages or not has_letter(raw.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, False
        p = _softmax(self.logits(features(raw, len(self.embedding))) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] >= self.reject_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = DIM, seed: int = 7, max_error: float = MAX_ERROR) -> Model:
    """``rows``: language, buckets that are hit, and how often; in a fixed order."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    model = Model(
        languages, rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages)), 1.0, 0.0
    )
    if len(languages) < 2:
        return model
    kept_out = [k for k in range(len(rows)) if k % 5 == 4]
    train = np.array([k for k in range(len(rows)) if k % 5 != 4])
    number = {name: k for k, name in enumerate(languages)}

    def dense(which) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(which), buckets))
        for i, k in enumerate(which):
            x[i, rows[k][1]] = rows[k][2]
        return x, np.array([number[rows[k][0]] for k in which])

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            x, y = dense(order[lo : lo + BATCH])
            x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1))
            hidden = x @ model.embedding
            error = _softmax(hidden @ model.weights + model.bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = error @ model.weights.T
            model.weights -= rate * hidden.T @ error
            model.bias -= rate * error.sum(axis=0)
            used = np.flatnonzero(x.any(axis=0))
            model.embedding[used] -= rate * x[:, used].T @ back
    if not kept_out:
        return model
    found = []
    for lo in range(0, len(kept_out), BATCH):
        x, y = dense(kept_out[lo : lo + BATCH])
        found.append((model.logits(x), y))
    z, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    trial = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in trial]
    model.temperature = float(trial[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != y
    by_score = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(wrong[by_score]) <= max_error * np.arange(1, len(y) + 1))
    model.reject_below = float(score[by_score[good[-1]]]) if len(good) else 1.0
    return model


def learn(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS) -> Model:
    """A model of the languages in ``docs`` (doc_id, text, lang), from at most about ``per_language`` rows of each."""
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    place = F.xxhash64(F.lit(5), "doc_id", "text")
    drawn = known.where(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30)).select("lang", place.alias("place"), utf8(F.col("text")).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(r.as_py(), buckets) for r in batch.column(2)]
            hit = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(hit, pa.list_(pa.int32())),
                    pa.array([f[h] for f, h in zip(found, hit, strict=True)], pa.list_(pa.float32())),
                ],
                ["lang", "place", "hit", "often"],
            )

    rows = drawn.mapInArrow(run, "lang string, place long, hit array<int>, often array<float>").toArrow().sort_by("place")
    arrays = lambda c: [v.values.to_numpy(zero_copy_only=False) for v in c]
    return fit(list(zip(rows["lang"].to_pylist(), arrays(rows["hit"]), arrays(rows["often"]), strict=True)), buckets)


_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identify(docs: DataFrame, model: Model, into: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``into``: struct of lang, score and accepted."""
    parts = (model.languages, model.embedding, model.weights, model.bias, model.temperature, model.reject_below)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*parts)
        for raws in batches:
            found = [model.predict(r.as_py()) for r in raws]
            yield pa.array([{"lang": a, "score": b, "accepted": c} for a, b, c in found], _PREDICTED)

    predict = F.arrow_udf(run, "struct<lang:string,score:double,accepted:boolean>")
    return docs.withColumn(into, predict(F.col(f"`{text_col}`").cast("binary")))


def report(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document; documents whose crc32 leaves the remainder 1 by 3 are held out of training."""
    docs = docs.select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs, ~held_out & F.col("doc_id").isNotNull(), per_language)
    rows = identify(docs.select("doc_id", "text"), model, "found")
    f = F.col("found")
    return rows.select("doc_id", held_out.alias("held_out"), f["lang"].alias("lang_pred"), f["score"].alias("score"), f["accepted"].alias("accepted"))
