"""Searches in buckets of equal length: every score by brute force, small buckets and blocks, large numbers, defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import lexical, negatives
from tablelens.llm.integers import products, whole


def brute_ranks(docs, items, k):
    terms = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    tfs = [(i, tf, tf.total()) for i, tf in tfs if tf]
    n_docs, n_terms = len(tfs), sum(n for *_, n in tfs)
    df = Counter(t for _, tf, _ in tfs for t in tf)
    out = []
    for name, text in items:
        scores = []
        for i, tf, n in tfs:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(name, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["The", "of", "Straße", "x1", "é", "data", "zebra", "quartz", "İstanbul"] + [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(rng.choice(words[: rng.randrange(2, len(words))]) + rng.choice(["", ",", "-x"]) for _ in range(n))
    docs = [(k, some(rng.randrange(60))) for k in range(200)] + [(200, None), (201, ""), (202, "--- !!"), (None, some(20)), (7, some(9)), (7, some(9))]
    docs += [(300 + k, docs[5][1]) for k in range(40)]  # copies tie
    items = [(k, some(rng.randrange(1, 25))) for k in range(12)] + [(12, None), (13, "unheard of"), (None, some(5)), (3, some(5)), (14, "zzz"), (15, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("settings", [{}, {"bucket": 7, "most_items": 4}, {"bucket": 1, "k": 3}])
def test_ranks_against_all_scores(spark, documents, texts, settings):
    docs, items = texts
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")
    found = lexical.rank(documents(docs, extra="impacts"), asked, **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_ranks(docs, items, settings.get("k", 20))


def test_no_documents_or_items(spark, documents, texts):
    docs, items = documents(texts[0][:20]), spark.createDataFrame(texts[1], "item_id long, text string")
    assert lexical.report(docs.where("false"), items).count() == lexical.report(docs, items.where("false")).count() == 0
    assert lexical.report(docs.where("doc_id < 0"), items.where("item_id = 12")).count() == 0


def test_buckets_leave_out_what_cannot_reach_the_floor():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = rng.integers(1, 30)
        pairs = sorted({(int(d), int(t)) for d, t in rng.integers(0, [n, 12], (80, 2))})
        doc, term = np.array(pairs).T
        impact = rng.integers(0, 1000, len(doc))
        bucket = lexical.Bucket(n, doc, term, impact)
        item = [(int(t), int(c)) for t, c in zip(rng.choice(14, 5, replace=False), rng.integers(1, 4, 5), strict=True)]
        dense = np.zeros((n, 14), np.int64)
        dense[doc, term] = impact
        score = sum(c * dense[:, t] for t, c in item)
        floor = int(rng.integers(1, score.max() + 2))
        places, got = bucket.search(item, floor)
        assert places.tolist() == np.flatnonzero(score >= floor).tolist() and got.tolist() == score[places].tolist()


def brute_negatives(rows, positives=5, negatives_=10):
    least, most = -(2**63), 2**63 - 1
    ok = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows
          if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, v in ok:
        if a % 100:
            continue
        scored = [(min(max(sum(x * y for x, y in zip(v, w, strict=True)), least), most), j, other) for j, other, w in ok if j != a and len(w) == len(v)]
        for s, p, _ in sorted((x for x in scored if x[2] == label), key=lambda x: (-x[0], x[1]))[:positives]:
            good = sorted((x for x in scored if x[2] != label and 30 * s <= 100 * x[0] <= 90 * s), key=lambda x: (-x[0], x[1]))[:negatives_]
            out += [(a, p, r + 1, j, s, t) for r, (t, j, _) in enumerate(good)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>"


def vectors(rng, n=420, dim=6, scale=1.0):
    rows = [(k, int(rng.integers(4)), (rng.normal(size=dim) * scale * rng.uniform(0.2, 3)).tolist()) for k in range(n)]
    for k in range(0, n, 3):
        rows[k] = (k, rows[k][1], (np.array(rows[k - k % 60][2]) + rng.normal(size=dim) * 0.3 * scale).tolist())
    return rows


@pytest.mark.parametrize("settings", [{}, {"bucket": 16, "focus": 2, "most_anchors": 2}, {"bucket": 3, "focus": 6}])
@pytest.mark.parametrize("scale", [1.0, 5e4, 1e12, 1e250])
def test_negatives_against_all_scores(spark, settings, scale):
    rows = vectors(np.random.default_rng(6), 330, scale=scale)
    rows += [(1000, None, [1.0] * 6), (None, 1, [1.0] * 6), (1100, 1, None), (1200, 1, [math.nan] * 6), (1300, 1, [math.inf] * 6), (1400, 2, [1.0, None] * 3)]
    rows += [(1500, 1, [0.0] * 6), (1600, 1, [1.0, 2.0]), (1601, 1, [1.0, 2.1]), (1602, 2, [0.5, 0.7]), (1700, 3, [])]
    rows += [(2000 + k, 2, rows[1][2]) for k in range(60)] + [rows[4]] * 3 + [rows[100]] * 2  # one vector of many rows, repeated rows and anchors
    table = spark.createDataFrame([(*r, "x") for r in rows], f"{VECTORS}, row string")
    found = negatives.report(table, **settings)
    expected = brute_negatives(rows)
    assert sorted(tuple(r) for r in found.collect()) == expected and len(expected) > 30


def test_negatives_without_anchors(spark):
    table = spark.createDataFrame(vectors(np.random.default_rng(1), 90)[1:], VECTORS)
    assert negatives.report(table).count() == 0
    assert negatives.report(table.where("false")).count() == 0
    assert negatives.mine(table, F.col("id") < 5, negatives=1).where("rank > 1").count() == 0


def test_candidates_hold_all_that_reach_the_score():
    rng = np.random.default_rng(2)
    kept = 0
    for _ in range(80):
        v = rng.normal(size=(40, 5))
        v *= rng.uniform(0.9, 1, (40, 1)) / np.sqrt((v**2).sum(axis=1, keepdims=True))
        v[rng.random(40) < 0.1] = 0
        bucket = negatives.Bucket(np.arange(40), np.zeros(40), v, 256)
        q = negatives.Block(np.arange(1), np.zeros(1), rng.normal(size=(1, 5)), 256)
        score = products(q.v, bucket.v)[0]
        least = int(np.sort(score)[-rng.integers(1, 5)]) if rng.random() < 0.8 else int(rng.choice(score))
        found = bucket.candidates(q.unit[0], q.length[0], least, np.argsort(-np.abs(q.unit[0]))[: rng.integers(1, 6)])
        found = np.arange(40) if found is None else found
        assert set(np.flatnonzero(score >= least)) <= set(found.tolist()) and len(set(found.tolist())) == len(found)
        kept += len(found)
    assert kept < 80 * 40 * 0.8  # something is left out


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for scale in (1.0, 1e6, 1e9, 3e8, 1e17, 1e300):
        a, b = whole(rng.normal(size=(4, 3)) * scale), whole(rng.normal(size=(5, 3)) * scale)
        exact = [[min(max(sum(int(x) * int(y) for x, y in zip(u, w, strict=True)), -(2**63)), 2**63 - 1) for w in b.tolist()] for u in a.tolist()]
        assert products(a, b).tolist() == exact
