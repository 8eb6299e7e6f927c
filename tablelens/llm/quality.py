"""Quality classifier: document evidence combined with hierarchical site posteriors (empirical Bayes).

1. A document classifier is fitted on labelled documents.  Words (and the
   symbols that hang on words) whose frequency differs reliably between bad
   and good documents carry log-likelihood ratios; these sums and the shape of
   the text enter a logistic regression.  Its output, minus the log odds of
   the training rows, is the evidence of a document: a log Bayes factor.
2. Every document's probability under the global prior is summed per path and
   per host by grouped aggregation.  A host's rate of bad documents is shrunk
   towards the global rate, a path's towards its host's: with n documents and
   prior strength k the posterior is (sum + k * prior) / (n + k).  The strength
   is estimated from the spread of the sites (moments of a beta-binomial), so
   sites that differ little or have few documents hardly move.
3. A document's final log odds are its site's posterior, without its own
   contribution, plus its evidence.

The fit uses at most about ``sample`` labelled documents (a parameter: which
ones, a hash of the id decides); everything else covers all documents.

Null texts are empty.  A null host or path is a site of its own.  Without
labels of both kinds there is nothing to learn: the evidence is 0 and all
documents pass.  Repeated labels of one document count once, the worst.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, utf8

SAMPLE = 12_000
# A word counts as evidence from this likelihood ratio statistic, log odds ratio and number of documents on.
MIN_GAIN, MIN_RATIO, MIN_DOCS = 18.0, 1.0, 5
# Bound of the site term, so that a site alone cannot outweigh clear evidence.
SITE_BOUND = 3.0
# Rows of the table of sites up to which it is sent to all tasks.
BROADCAST_SITES = 100_000
# Above this probability of being bad a document is rejected; clean ones with little text lie between.
MAX_BAD = 0.7

SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
# A to Z become small, digits become 0, other symbols stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
# Each byte's class: letter (small, capital, beyond ASCII), digit, space, other.
CLASS = np.array(
    [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if c >= 128 else 3 if 48 <= c <= 57 else 4 if chr(c).isspace() else 5 for c in range(256)],
    np.uint8,
)


def features_of(raw: bytes) -> tuple[list[int], list[float]]:
    """Hashes of the distinct words of a text, with the symbols at their ends as words too, and its shape."""
    words = raw.translate(FOLD).split()
    n = len(words)
    kinds = set(words)
    out, tails = set(), 0
    for w in kinds:
        core = w.strip(SYMBOLS)
        if core:
            out.add(core)
        if len(core) != len(w):
            tail = w[len(w.rstrip(SYMBOLS)) :]
            if tail not in (b"", b".", b","):
                out.add(b"~" + tail[:8])
                tails += 1
    share = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=6) / max(1, len(raw))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n)
    shape = [
        float(share[1]), float(share[3]), float(share[5]), tails / max(1, len(kinds)), repeats,
        1.0 - len(kinds) / max(1.0, float(n)) if n > 50 else 0.0, math.log1p(n) / 10.0,
    ]
    return [xxhash.xxh3_64_intdigest(w) for w in out], shape


@dataclass
class Model:
    """Weights of words, and of the regression on (sum of positive weights, sum of negative ones, shape)."""

    weights: dict[int, float]
    coefficients: np.ndarray
    prior: float

    def evidence(self, raw: bytes) -> float:
        words, shape = features_of(raw)
        x = np.array(_row(self.weights, words, shape))
        return float(np.clip(x @ self.coefficients, -12, 12) - self.prior)


def _row(weights: dict[int, float], words: list[int], shape: list[float]) -> list[float]:
    found = [weights[w] for w in words if w in weights]
    return _evidence_row(np.array(found, float), shape)


def _evidence_row(found: np.ndarray, shape: list[float]) -> list[float]:
    up, down = found[found > 0].sum(), -found[found < 0].sum()
    return [1.0, math.log1p(up), max(0.0, found.max(initial=0.0)), -math.log1p(down), *shape]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the intercept is free."""
    beta, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge @ beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _weigh(words: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (hashes, ascending) that tell bad from good reliably, and their log odds ratios."""
    n = np.array([(bad == k).sum() for k in (0, 1)])
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    of = np.repeat(bad, [len(w) for w in words])
    count = [np.bincount(place[of == k], minlength=len(known)) for k in (0, 1)]
    having, total = count[0] + count[1], n.sum()
    gain = np.zeros(len(known))  # likelihood ratio statistic of the word's two-by-two table
    for k in (0, 1):
        for seen, margin in ((count[k], having), (n[k] - count[k], total - having)):
            expected = margin * n[k] / total
            gain += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)
    ratio = np.log((count[1] + 0.5) * (n[0] - count[0] + 0.5) / ((count[0] + 0.5) * (n[1] - count[1] + 0.5)))
    chosen = (having >= MIN_DOCS) & (gain >= MIN_GAIN) & (np.abs(ratio) >= MIN_RATIO)
    return known[chosen], ratio[chosen]


def fit(words: list[np.ndarray], shapes: list[list[float]], bad: np.ndarray) -> Model | None:
    """``bad``: 1 or 0.  Half of the texts choose the words, the other half fit the regression, and in turn."""
    if not 0 < bad.sum() < len(bad):
        return None
    x, y = [], []
    for k in (0, 1):
        known, ratio = _weigh(words[k::2], bad[k::2]) if len(bad) > 1 else (np.empty(0, np.uint64), np.empty(0))
        for w, shape in zip(words[1 - k :: 2], shapes[1 - k :: 2], strict=True):
            at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
            found = ratio[at[known[at] == w]] if len(known) else np.empty(0)
            x.append(_evidence_row(found, shape))
        y.append(bad[1 - k :: 2])
    y = np.concatenate(y).astype(float)
    rate = y.mean()
    known, ratio = _weigh(words, bad)
    weights = dict(zip(known.tolist(), ratio.tolist(), strict=True))
    return Model(weights, _logistic(np.array(x), y), math.log(rate / (1 - rate)))


def _learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bad: Column, sample: int) -> Model | None:
    """The model of about ``sample`` labelled texts, or of all that is labelled if it is less."""
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(bad.cast("int")).alias("bad"))
    marked = marked.where("bad IS NOT NULL")
    total = marked.count()
    if total > sample:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), utf8(F.col(f"`{text_col}`")).alias("raw"))
    # The labels to learn from are at most about ``sample`` rows.
    rows = texts.join(F.broadcast(marked), "id").select("raw", "bad", F.xxhash64("id", "raw").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(r.as_py()) for r in batch.column(0)]
            words = [np.array(w, np.uint64).view(np.int64) for w, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                ["words", "shape", "bad", "place"],
            )

    table = rows.mapInArrow(run, "words array<long>, shape array<double>, bad int, place long").toArrow().sort_by("place")
    words = [np.asarray(w.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for w in table["words"]]
    return fit(words, table["shape"].to_pylist(), table["bad"].to_numpy().astype(int))


def with_evidence(df: DataFrame, model: Model | None, into: str, text_col: str) -> DataFrame:
    if model is None:
        return df.withColumn(into, F.lit(0.0))
    weights, coefficients, prior = model.weights, model.coefficients, model.prior

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged = Model(weights, coefficients, prior)
        for raws in batches:
            yield pa.array([judged.evidence(r.as_py()) for r in raws], pa.float64())

    return df.withColumn(into, F.arrow_udf(judge, "double")(utf8(F.col(f"`{text_col}`"))))


def _strength(rate: Column, base: Column) -> Column:
    """Prior strength from the spread of site rates around their base, as an aggregate over sites with two documents or more.

    The variance of a site's rate is base(1 - base)(1 + (n - 1) r) / n with r = 1 / (k + 1); solved for k,
    kept between 1 and 1000.
    """
    n = F.col("n")
    counted = F.when(n > 1, n)
    spread = F.sum(counted * (rate - base) * (rate - base))
    expected = F.sum(F.when(n > 1, base * (1 - base)))
    more = F.sum(F.when(n > 1, base * (1 - base) * (n - 1)))
    r = (spread - expected) / F.when(more > 0, more)
    return F.coalesce(F.least(F.greatest(1 / F.greatest(r, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, mass, host_rate, k_path, ...) from rows (host, path, p): p is a document's probability of being bad."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("mass")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    world = hosts.agg(F.sum("mass") / F.sum("n")).scalar()
    k_host = hosts.select("n", "mass", world.alias("base")).agg(_strength(F.col("mass") / F.col("n"), F.col("base"))).scalar()
    rated = hosts.select("host", "n", "mass", world.alias("world"), k_host.alias("k_host"))
    rated = rated.select(
        F.col("host").alias("site"), "world", ((F.col("mass") + F.col("k_host") * F.col("world")) / (F.col("n") + F.col("k_host"))).alias("host_rate")
    )
    joined = paths.join(materialize(rated, "hosts"), F.col("host").eqNullSafe(F.col("site"))).select("host", "path", "n", "mass", "host_rate", "world")
    k_path = joined.agg(_strength(F.col("mass") / F.col("n"), F.col("host_rate"))).scalar()
    return joined.withColumn("k_path", k_path)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    bad: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    sample: int = SAMPLE,
    into: str = "quality",
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``into``: struct of evidence, site (posterior rate without the document) and p_bad.

    Evidence is written with the other columns if the text may be left out.  Else what the sites need is written
    only, and texts are judged again where they are read for the result, which no copy of the table is stored for.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    model = _learn(docs, labels, id_col, text_col, bad, sample)
    prior = model.prior if model else 0.0
    p_alone = lambda e: 1 / (1 + F.exp(-(e + prior)))
    e = fresh(docs, "evidence")
    scored = with_evidence(docs, model, e, text_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    if not keep_text:
        scored = materialize(scored.select(*[F.col(f"`{c}`") for c in kept], e), "evidence")
    sites = scored.select(F.col(f"`{host_col}`").alias("host"), F.col(f"`{path_col}`").alias("path"), p_alone(F.col(e)).alias("p"))
    known = site_posteriors(sites)
    s = {c: fresh(docs, f"site_{c}") for c in known.columns}
    known = materialize(known.withColumnsRenamed(s), "sites")
    if known.count() <= BROADCAST_SITES:  # else a join by site, whose large groups Spark splits
        known = F.broadcast(known)
    both = scored.join(
        known, F.col(f"`{host_col}`").eqNullSafe(F.col(s["host"])) & F.col(f"`{path_col}`").eqNullSafe(F.col(s["path"]))
    )
    own = p_alone(F.col(e))
    rate = (F.col(s["mass"]) - own + F.col(s["k_path"]) * F.col(s["host_rate"])) / (F.col(s["n"]) - 1 + F.col(s["k_path"]))
    shift = _logit(rate) - _logit(F.col(s["world"]))
    shift = F.least(F.greatest(shift, F.lit(-SITE_BOUND)), F.lit(SITE_BOUND))
    final = F.col(e) + F.lit(prior) + shift
    return both.withColumn(
        into,
        F.struct(F.col(e).alias("evidence"), rate.alias("site"), (1 / (1 + F.exp(-final))).alias("p_bad")),
    ).select(*[F.col(f"`{c}`") for c in kept], into)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: evidence, site rate, probability of being bad, and whether it stays."""
    rows = classify(docs.select("doc_id", "text", "source", "lang"), labels, keep_text=False)
    q = F.col("quality")
    return rows.select(
        "doc_id", F.round(q["evidence"], 6).alias("evidence"), F.round(q["site"], 6).alias("site_rate"),
        F.round(q["p_bad"], 6).alias("p_bad"), (q["p_bad"] <= MAX_BAD).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """``docs`` without those that are bad with a probability above ``max_bad``."""
    name = fresh(docs, "quality")
    return classify(docs, labels, into=name).where(F.col(name)["p_bad"] <= max_bad).select(*[F.col(f"`{c}`") for c in docs.columns])
