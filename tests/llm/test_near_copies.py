"""Near copies by Jaccard similarity: all pairs by brute force, dense groups, and the stage of the pipeline."""

import random

import corpus_pipeline

from tablelens.llm import shingles, simhash


def brute_kept(texts):
    """The ids that stay: the least of each component of all pairs with a similarity of 0.8 or more."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return set(label.values())


def family(rng, n, copies, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(n)]
    for _ in range(copies):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
        yield " ".join(copy)


def test_near_copies_against_all_pairs(documents):
    rng = random.Random(11)
    texts = [None, "", " ", "one", "One", "two words here", "a b c d e", "a b c d e f"]
    for n, edits in ((30, 3), (60, 4), (120, 8), (200, 9), (250, 14)):
        for _ in range(3):
            texts += family(rng, n, 8, edits)
    texts += family(rng, 80, 60, 5)  # a dense group
    line = " ".join(f"line{k}" for k in range(12))  # a passage of many texts that are no copies
    texts += [line + " " + " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 40))) for _ in range(60)]
    texts += [texts[20]] * 5
    docs = documents(list(enumerate(texts)), extra="row")
    kept = shingles.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(brute_kept(dict(enumerate(texts))))
    assert shingles.drop_near_copies(docs.where("false")).count() == 0


def test_the_stage_drops_copies_beyond_three_bits(spark, documents):
    rng = random.Random(14)
    words = [f"w{rng.randrange(900)}" for _ in range(200)]
    copy = [f"new{k}" if k % 50 == 25 else w for k, w in enumerate(words)]
    a, b = " ".join(words), " ".join(copy)
    assert (simhash.fingerprint(a.encode(), 3) ^ simhash.fingerprint(b.encode(), 3)).bit_count() > 3
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert [r.doc_id for r in stage(spark, documents([(1, a), (2, b)]), "").collect()] == [1]
