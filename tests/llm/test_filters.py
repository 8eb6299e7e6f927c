"""Mixing, quality, decontamination, personal data: results by hand and by brute force, and defined cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.llm import decontaminate, language, mixing, pii, quality

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(value):
    digits = [int(c) for c in reversed(re.sub("[^0-9]", "", value))]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0


def expected_spans(text):
    valid = {
        "email": lambda v: True,
        "ip": lambda v: all(int(p) <= 255 for p in v.split(".")),
        "card": lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(v),
        "phone": lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15,
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid[k](m[0])]


def expected_redactions(text):
    """Places of the base spans and secrets whose context does not speak against them."""
    found = [s.split(":") for s in expected_spans(text)]
    found += [("secret", m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])(?=[A-F]*[0-9])(?=[0-9]*[A-F])[0-9A-F]{32,64}(?![A-Za-z0-9])", text or "", re.I)]
    out = []
    for name, start, end in found:
        kind = next(k for k in pii.BASE + pii.ADDED if k.name == name)
        near = f"{text[max(0, int(start) - 48) : int(start)]} {text[int(end) : int(end) + 24]}".lower()
        has = lambda words: any(re.search(f"(?:^|[^a-z]){w}", near) for w in words)  # noqa: B023, E731
        if round(kind.score + kind.up * has(kind.words) - 0.3 * has(kind.against), 2) >= 0.5:
            out.append((int(start), int(end)))
    return out


TEXTS = [
    None, "", "plain", "a@b.c_x@d.e", "x a.b@c-d.org, mail é me@host.example", "a@b..c d@e.f.",
    "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0255", "4111 1111 1111 1111", "4111111111111112 4111-1111-1111-1111",
    "é 4111  1111 1111 1111 1111", "12345678901234567890123 41111111111111111111", "+1 (017) 555-7713 and +123 +1 2",
    "GB82 WEST 1234 5698 7654 32 and DE89370400440532013000", "a" * 3000 + "@x.y", "1 " * 500, "😀 me@x.yz 10.0.0.1",
]


def test_pii_against_regular_expressions(documents):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("0123456789 .-+@ab()") for _ in range(rng.randrange(120))) for _ in range(400)]
    rows = {r.doc_id: r for r in pii.report(documents(list(enumerate(texts)), extra="n_email")).collect()}
    for k, text in enumerate(texts):
        spans = expected_spans(text)
        assert rows[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert rows[k].spans.split(",")[: len(spans)] == (spans or rows[k].spans.split(",")[:0]), text
        assert [rows[k].n_email, rows[k].n_ip, rows[k].n_card, rows[k].n_phone] == [
            sum(s.startswith(kind) for s in spans) for kind in BASE
        ]
    assert rows[12].spans.count("iban") == 2


def test_pii_context_moves_the_score(documents):
    found = pii.find(documents([(1, "call +1 234 567 890"), (2, "order +1 234 567 890"), (3, "so +1 234 567 890")]))
    scores = {r.doc_id: r.pii.phone[0].score for r in found.collect()}
    assert scores[1] > scores[3] > scores[2]


def test_pii_context_changes_what_is_reported_and_redacted(documents):
    digits = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    texts = [
        f'token = "{digits}"', f"commit {digits}", digits, f"API_KEY {digits.upper()}!", f"token {digits}9", f"secret {digits * 2}", "key " + "1" * 40,
        "order +1 234 567 890", "call about order +1 234 567 890", "version 10.0.0.1", "tracking 4111111111111111", "server version 10.0.0.1",
    ]
    docs = documents(list(enumerate(texts)))
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert rows[0].spans == "secret:9:49" and rows[0].scores == "70" and clean[0] == 'token = "[SECRET]"'
    assert rows[3].scores == "70" and clean[3] == "API_KEY [SECRET]!"
    for k in (1, 2, 5, 6):
        assert rows[k].spans == rows[k].scores == "" and clean[k] == texts[k], k
    assert (rows[4].spans, clean[4]) == ("secret:6:47", "token [SECRET]")
    # Base spans stay in the report; against a low score the text stays.
    assert [rows[k].scores for k in (7, 8, 9, 10, 11)] == ["40", "60", "30", "40", "50"]
    assert [clean[k] for k in (7, 8, 9, 10, 11)] == [texts[7], "call about order [PHONE]", texts[9], texts[10], "server version [IP]"]
    assert all(n == 1 for n in (rows[7].n_phone, rows[8].n_phone, rows[9].n_ip, rows[10].n_card))


def test_redaction(documents):
    docs = documents([(1, "mail a@b.cd or 4111111111111111 now"), (2, None), (3, "clean"), (3, "clean")], extra="pii_spans")
    rows = sorted((r.doc_id, r.text) for r in pii.redact(docs).collect() if r.text)
    assert rows == [(1, "mail [EMAIL] or [CARD] now"), (3, "clean"), (3, "clean")]
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.where("false")).count() == 0


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        x = words(item)
        for k in range(max(1, len(x) - size + 1)) if x else ():
            g = x[k : k + size]
            for s in range(len(w) - len(g) + 1):
                if w[s : s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_against_brute_force(spark, documents, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "Tor", "über", "x9", "rare" + str(rng.randrange(30))])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 14])))) for k in range(9)] + [(9, None), (3, "of the"), (None, "x9 x9")]
    texts = [None, "", "of", "of, THE"]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(12))), rng.choice(items)[1] or "", "- ".join(word() for _ in range(rng.randrange(6)))]
        texts.append(rng.choice([" ", ". "]).join(parts))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontaminate.report(documents(list(enumerate(texts)), extra="hits"), bench, block=block).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
    assert got == {k: brute_hits(t, items) for k, t in enumerate(texts)}


def test_decontamination_without_items(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = documents([(1, "a b"), (1, "a b"), (None, None)])
    assert [r.contaminated for r in decontaminate.report(docs, none).collect()] == [False] * 3
    assert decontaminate.drop_contaminated(docs, none).count() == 3
    assert decontaminate.report(docs.where("false"), none).count() == 0


def test_raking_meets_given_targets(spark):
    cells = spark.createDataFrame(
        [(s, g, t, 1000 + 100 * k) for k, (s, g, t) in enumerate((s, g, t) for s in ("a", "b", None) for g in ("en", "de") for t in ("x", "y"))],
        "source string, lang string, topic string, tokens bigint",
    )
    wanted = {
        "source": spark.createDataFrame([("a", 0.2), ("b", 0.5), (None, 0.3)], "k string, share double"),
        "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "k string, share double"),
        "topic": spark.createDataFrame([("x", 0.5), ("y", 0.5)], "k string, share double"),
    }
    raked = mixing.rake(cells, wanted, budget=0.3)
    total = raked.agg(F.sum("weight")).first()[0]
    for key, table in wanted.items():
        got = {r[0]: r[1] / total for r in raked.groupBy(key).agg(F.sum("weight")).collect()}
        assert got == pytest.approx({r[0]: r[1] for r in table.collect()}, abs=1e-4)
    assert total == pytest.approx(0.3 * cells.agg(F.sum("tokens")).first()[0], rel=1e-4)


def test_raking_in_several_tasks_gives_the_same(spark, monkeypatch):
    cells = spark.createDataFrame([(f"s{k % 7}", f"l{k % 3}", f"t{k % 2}", 10 + k) for k in range(42)], "source string, lang string, topic string, tokens bigint")
    cells = cells.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    read = lambda: {(r.source, r.lang, r.topic): r.probability for r in mixing.rake(cells, cycles=3).collect()}
    together = read()
    monkeypatch.setattr(mixing, "CELLS_AT_A_TIME", 10)
    assert read() == pytest.approx(together)


def test_mixing_defined_cases(documents):
    docs = documents([(1, "a b", None, None, 3), (2, None, "en", "s", 0), (2, None, "en", "s", 0), (None, "x", "de", "s", 1)], extra="mix")
    assert mixing.report(docs).count() == 4
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.report(docs.where("false")).count() == 0


def labelled(spark, documents, n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice("the sun is on a hill and rain falls over green fields".split()) for _ in range(rng.randrange(20, 80))]
        bad = k % 4 == 0
        if bad:
            words = [w + "%%%" for w in words] if k % 8 == 0 else [*words, "scum"]
        rows.append((k, " ".join(words), "en", f"s{k % 5}", 0))
        labels.append((k, 0 if k % 8 == 0 else 1, int(bad and k % 8 != 0)))
    return documents(rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_on_held_out_documents(spark, documents):
    docs, labels = labelled(spark, documents)
    rows = quality.report(docs, labels.where("doc_id % 3 > 0")).where("doc_id % 3 = 0").collect()
    right = [r.keep == (r.doc_id % 4 != 0) for r in rows]
    assert sum(right) >= 0.95 * len(right)


def test_sparse_sites_shrink_more(spark):
    rows = [("big", "p", 0.9)] * 200 + [("small", "p", 0.9)] * 2 + [("other", "p", 0.1)] * 200 + [(None, None, 0.5)]
    sites = {r.host: r for r in quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    assert sites["big"].host_rate > sites["small"].host_rate > sites["small"].world
    assert len(sites) == 4


def test_quality_defined_cases(spark, documents):
    docs, labels = labelled(spark, documents, 60)
    odd = documents([(1000, None, None, None, 0), (1001, "", "en", "s1", 0), (1001, "", "en", "s1", 0), (None, "the sun", "en", "s1", 7)])
    both = docs.union(odd)
    assert quality.report(both, labels).count() == 64
    assert quality.keep_good(both, labels.where("false")).count() == 64  # nothing to learn from
    assert quality.report(both.where("false"), labels).count() == 0


def test_language_on_held_out_rows(documents):
    rng = random.Random(7)
    vocabulary = {"en": "the of and to in is was for".split(), "de": "der und die das ist für nicht über".split(), "fr": "le la et les été des une où".split()}
    rows = []
    for k in range(600):
        lang = rng.choice(list(vocabulary))
        rows.append((k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(3, 40))), lang if k % 7 else None, "s", 0))
    rows += [(600, None, "en", "s", 0), (601, "123 !?", "en", "s", 0), (602, "", None, "s", 0)]
    truth = {r[0]: r[2] for r in rows}
    found = language.report(documents(rows)).collect()
    held = [r for r in found if r.held_out and truth[r.doc_id] and r.doc_id < 600]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 0
    assert {r.lang_pred for r in found if r.doc_id >= 600} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)


def test_language_defined_cases(documents):
    none = documents([(1, "abc", None, None, 3), (None, "x", None, None, 1)])
    assert {r.lang_pred for r in language.report(none).collect()} == {"und"}
    one = documents([(0, "abc", "en", "s", 3), (2, "abd", "en", "s", 3), (3, "x", "en", "s", 1)])
    assert {r.lang_pred for r in language.report(one).collect()} == {"en"}
    assert language.report(one.where("false")).count() == 0
    long = language.features(b"ab cd " * 400_000, 64)
    assert long.sum() > 4 * 2_000_000


def test_mixing_reports_what_targets_miss(spark):
    """A label with less than its target wants gives all it has; the rest goes to the others, and the gaps are told."""
    cells = spark.createDataFrame(
        [(s, lang, t, n) for s, a in (("s1", 50), ("s2", 50)) for lang, b in (("en", 6), ("de", 4)) for t, c in (("prose", 97), ("code", 3)) for n in (a * b * c,)],
        "source string, lang string, topic string, tokens long",
    )
    wanted = {"topic": spark.createDataFrame([("prose", 0.5), ("code", 0.5)], "topic string, share double")}
    raked = mixing.rake(cells, wanted, budget=0.5, temperature=1.0)
    found = {(r.key, r.label): r for r in mixing.balance(raked).collect()}
    assert found["topic", "code"].weight == pytest.approx(3000, rel=1e-4) and found["topic", "code"].share == pytest.approx(0.06, abs=1e-4)
    assert found["topic", "code"].gap == pytest.approx(-0.44, abs=1e-4) and found["topic", "prose"].gap == pytest.approx(0.44, abs=1e-4)
    assert all(abs(found[k].gap) < 1e-4 for k in found if k[0] != "topic")
    cut = {(r.key, r.label): r for r in mixing.balance(mixing.rake(cells, wanted, budget=0.5, temperature=1.0, cut_budget=True)).collect()}
    assert all(abs(r.gap) < 1e-3 for r in cut.values()) and cut["topic", "code"].weight == pytest.approx(3000, rel=1e-2)
