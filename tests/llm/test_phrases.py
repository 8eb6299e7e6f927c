"""Recurring passages: all windows by brute force, hot anchors, defined cases."""

import hashlib
import random
import re

import pytest

from tablelens.llm import phrases


def brute(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    places = {}
    for k, w in enumerate(words):
        for s in range(len(w) - length + 1):
            places.setdefault(tuple(w[s : s + length]), []).append((k, s))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for k, s in found:
                gone[k].update(range(s, s + length))
    return [(len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for w, g in zip(words, gone, strict=True)]


def corpus(rng, n=120):
    """Own words, passages cut at any place, copies, copies with edits, a passage within itself, words of few letters."""
    word = lambda k: rng.choice(["tion", "Er", "lé", "x"]) + str(rng.randrange(k))
    passages = [[word(300) for _ in range(rng.randrange(8, 120))] for _ in range(12)]
    texts = [None, "", " \t\x0b\n", "one", "two words"]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [word(10**6) for _ in range(rng.randrange(30))] + p[a : a + rng.randrange(len(p))]
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    texts += [texts[20]] * 3 + [" ".join(passages[0] * 3), " ".join(["same"] * 50), " ".join(["same"] * 9), " ".join(["a", "b"] * 40)]
    return texts


def rows_of(spark, texts, documents, **settings):
    found = phrases.report(documents(list(enumerate(texts)), extra="text_key"), **settings).collect()
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found}
    assert len(found) == len(texts)
    return [rows[k] for k in range(len(texts))]


@pytest.mark.parametrize("length, gram", [(35, 8), (10, 4), (6, 6), (2, 1)])
def test_against_all_windows(spark, documents, length, gram):
    texts = corpus(random.Random(length))
    assert rows_of(spark, texts, documents, length=length, gram=gram) == brute(texts, length)


def test_divided_anchors_and_shared_tasks_change_nothing(spark, documents):
    """A passage in many contexts: its anchors have many kinds and many phrases."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(12)]
    around = [[f"w{rng.randrange(40)}" for _ in range(6)] for _ in range(60)]
    texts = [" ".join(rng.choice(around) + passage + rng.choice(around)) for _ in range(150)]
    expected = brute(texts, 14)
    assert 0 < sum(r[1] for r in expected) < sum(r[0] for r in expected)
    for most in ({}, {"most_phrases": 5, "most_pieces": 3}, {"most_phrases": 2, "most_pieces": 1000}):
        assert rows_of(spark, texts, documents, length=14, gram=5, **most) == expected


def test_long_texts_are_cut_without_loss(spark, documents, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 600)
    texts = corpus(random.Random(4), 40)
    assert rows_of(spark, texts, documents, length=20, gram=6) == brute(texts, 20)


def test_defined_cases(spark, documents):
    text = " ".join(f"w{k}" for k in range(40))
    docs = documents([(None, text), (1, text), (1, text), (2, None), (3, text + " more")], extra="cut")
    out = phrases.remove(docs, "cut")
    assert sorted(out.columns) == sorted(docs.columns) and out.count() == 5
    assert {(r.doc_id, r.cut.n_removed, bytes(r.cut.kept)) for r in out.collect()} == {(None, 40, b""), (1, 40, b""), (2, 0, b""), (3, 40, b"more")}
    assert phrases.report(docs.where("false")).count() == 0
    assert phrases.report(docs.where("doc_id = 2")).first()[1:] == (0, 0, hashlib.sha256(b"").hexdigest())


def test_automaton_finds_what_comparison_finds():
    rng = random.Random(3)
    for _ in range(300):
        automaton, sought = phrases.Automaton(), []
        for _ in range(rng.randrange(5)):
            p = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 6))]
            length = rng.randrange(1, len(p) + 1)
            automaton.add(p, length)
            sought += [p[k : k + length] for k in range(len(p) - length + 1)]
        automaton.close()
        words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(20))]
        covered = {i for p in sought for k in range(len(words)) if words[k : k + len(p)] == p for i in range(k, k + len(p))}
        found = automaton.places(words)
        assert {i for r in found for i in range(r["begin"], r["end"])} == covered
        assert all(a["end"] < b["begin"] for a, b in zip(found, found[1:], strict=False))
