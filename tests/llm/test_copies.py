"""Near copies, long repeats, search, archives, pages: brute force, round trips and defined cases."""

import gzip
import io
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tablelens.llm import balltree, html, repeats, simhash, warc
from tablelens.llm.components import components


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), 42) for k in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(documents):
    rng = random.Random(1)
    base = [[rng.choice(["tion", "Er", "lé", "x"]) + str(rng.randrange(50)) for _ in range(300)] for _ in range(6)]
    texts = [None, "", " \t\x0b", "one", "Two words", "one"]
    for b in base:
        for _ in range(12):
            copy = list(b)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(9)}"
            texts.append(" ".join(copy))
    rows = {r.doc_id: r for r in simhash.report(documents(list(enumerate(texts)), extra="fp")).collect()}
    prints = {k: brute_print(t) for k, t in enumerate(texts)}
    label = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert {k: (r.fingerprint, r.component_id) for k, r in rows.items()} == {k: (f"{prints[k]:016x}", label[k]) for k in prints}


def test_links_of_close_fingerprints_are_complete(spark):
    """A dense group, fields at and off anchors, and the last two bits: the forest connects what the threshold does."""
    rng = random.Random(2)
    prints = {0, 1 << 63, (1 << 62) | 1}
    for centre in (0, rng.getrandbits(64)):
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    values = np.array(sorted(prints), np.uint64)
    one = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = components(simhash.links(one)).collect()
    got = {}
    for r in found:
        got.setdefault(r.root, set()).add(r.node)
    todo, expected = set(values.view(np.int64).tolist()), []
    while todo:
        group, front = set(), {todo.pop()}
        while front:
            group |= front
            front = {y for x in front for y in todo if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
            todo -= front
        expected.append(group)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in expected if len(g) > 1)


def test_one_of_each_group_stays(documents):
    text = " ".join(f"w{k}" for k in range(100))
    docs = documents([(5, text), (3, text), (3, text), (None, text), (7, "other words here now"), (8, None), (9, "")], extra="row")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert simhash.drop_near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(61)}, 200: 200, 201: 200}


def brute_repeats(texts, n):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[k : k + n] for r in raws for k in range(len(r) - n + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r), bool)
        for k in range(len(r) - n + 1):
            if count[r[k : k + n]] > 1:
                mark[k : k + n] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out.append((len(r), int(mark.sum()), runs, bytes(b for b, m in zip(r, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_against_counting(documents, hot):
    rng = random.Random(3)
    word = lambda: rng.choice(["tion", "é", "ab", "zu"]) + rng.choice(["", str(rng.randrange(99))])
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, passage[0], passage[0], "x" + passage[0][:150]]
    for _ in range(40):
        p = rng.choice(passage)
        a = rng.randrange(len(p))
        texts.append(" ".join(word() for _ in range(rng.randrange(30))) + p[a : a + rng.randrange(300)] + " ".join(word() for _ in range(rng.randrange(30))))
    rows = {r.doc_id: r for r in repeats.remove(documents(list(enumerate(texts)), extra="kept"), "cut", hot=hot).collect()}
    for k, (n, removed, runs, kept) in enumerate(brute_repeats(texts, 200)):
        cut = rows[k].cut
        assert (cut.n_removed, cut.n_spans, bytes(cut.kept)) == (removed, runs, kept), k
    assert repeats.report(documents([]).where("false")).count() == 0


def test_long_texts_are_cut_into_chunks(documents, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    texts = [text, text[100:2600], text[2000:] + "tail"]
    rows = {r.doc_id: r for r in repeats.report(documents(list(enumerate(texts)))).collect()}
    for k, (_, removed, runs, _) in enumerate(brute_repeats(texts, 200)):
        assert (rows[k].n_removed, rows[k].n_spans) == (removed, runs)


def brute_top(rows, k=5):
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in clean}.items():
        if q % 50 == 0:
            scores = sorted({(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in clean if i != q and len(w) == len(v)})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(20_000, 2_000, 128), (60, 3, 8)])
def test_search_against_brute_force(spark, sizes):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(k, (centres[k % 5] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for k in range(400)]
    rows += [(400 + k, rows[50][1]) for k in range(20)] + [(450, None), (451, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [1.0, 2.0]), (601, [0.5, 0.5]), (None, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shard, block, leaf = sizes
    found = balltree.top_k(table, F.col("id") % 50 == 0, shard=shard, block=block, leaf=leaf)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(rows)
    assert balltree.report(table.where("false")).count() == 0


def test_ball_tree_skips_leaves():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(500, 4)) + 100 * e for e in np.eye(4)]).round()
    tree = balltree.BallTree(np.arange(2000), vectors, 50)
    products, seen = balltree._products, []
    balltree._products = lambda a, b: seen.append(len(b)) or products(a, b)
    try:
        score, best = tree.search(np.array([-1]), vectors[:1], np.array([-np.inf]), 5)
    finally:
        balltree._products = products
    assert sum(seen) <= 1000 and score[0].tolist() == sorted(vectors @ vectors[0])[::-1][:5]


PAGES = [(1, "http://a/x", "same"), (2, "http://a/y", "same"), (3, None, None), (4, "http://b/é z", ""), (5, "u", "über\r\n\r\nWARC/1.1\r\n"), (None, "n", "same")]


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    written = warc.write_archives(pages, f"file://{tmp_path}", compress=compress)
    written.cache()
    rows = warc.read_archives(written).collect()
    assert [r for r in rows if r.gap] == []
    by_id = {r.record_id: r for r in rows}
    assert len(by_id) == 6
    for k, url, text in PAGES:
        r = by_id[f"<urn:x-page:{'' if k is None else k}>"]
        payload = (text or "").encode()
        assert (r.payload_digest, r.payload_bytes) == (warc.base32_sha1(payload), len(payload))
        assert r.record_type == ("revisit" if k in (2, 4, None) else "response")
        assert bytes(r.payload) == (payload if r.record_type == "response" else b"")
    assert warc.report(pages.where("false")).count() == 0
    large = {r.page_id: r.record_type for r in warc.report(pages, min_size=1).collect()}
    assert large[4] == "response" and large[2] == "revisit"


def _records(n, compress):
    parts = [warc.record_bytes("response", k, "http://h/", b"payload %d " % k * 50, warc.base32_sha1(b"payload %d " % k * 50), None) for k in range(n)]
    return [gzip.compress(p, mtime=0) for p in parts] if compress else parts


@pytest.mark.parametrize("compress", [True, False])
def test_damaged_records_are_skipped_and_logged(compress):
    rng = random.Random(8)
    for trial in range(60):
        parts = _records(6, compress)
        hurt = rng.randrange(6)
        at = rng.randrange(len(parts[hurt]))
        how = trial % 3
        if how == 0:
            parts[hurt] = parts[hurt][:at] + bytes([parts[hurt][at] ^ 0x55]) + parts[hurt][at + 1 :]
        elif how == 1:
            parts[hurt] = parts[hurt][:at]
        else:
            parts[hurt] = b"noise\x1f\x8b\x08 WARC/1.noise" + parts[hurt]
        data = b"".join(parts)
        found = list(warc.Archive(io.BytesIO(data), len(data)).salvage())
        names = [f["warc-record-id"] for _, _, f, _, _ in found if f]
        whole = {f"<urn:x-page:{k}>" for k in range(6) if k != hurt or how == 2}
        assert whole <= set(names)
        digests = [(f.get("warc-payload-digest", "")[5:], warc.base32_sha1(warc.http_payload(b)[1])) for _, _, f, b, _ in found if f]
        assert all(a == b for a, b in digests if a)
        places = sorted((o, n) for o, n, *_ in found)
        assert places[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(places, places[1:], strict=False))
        assert sum(places[-1]) == len(data)
    assert list(warc.Archive(io.BytesIO(b""), 0).salvage()) == []


def test_page_lines():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header>Top</header><nav><p>Menu</nav>
    <div class="cookie-notice">Cookies <div>more</div></div><main><article><h1>Head&amp;line</h1><p>One <b>two<br>three&nbsp;</b>
    <p>Four<script>var t = "</p>";</script><ul><li>a<li>b</ul><form>Send</form><aside>Side</aside><div style="display: none">x</div>
    <table><tr><td>c<td>d</table></article></main><section id="comments"><p>Nice!</section><footer>Foot</footer>"""
    assert html.main_text(html.lines_of(page), []) == "Head&line One two three Four a b c d"
    assert html.lines_of("") == [] and html.main_text([], []) == ""
    assert html.lines_of("a < b <p>c <unclosed") == [("a < b", False), ("c <unclosed", False)]


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        places = sorted(html.common_lines(a, b))
        rest = iter(b)
        assert len(places) == lcs(a, b) and all(any(x == y for y in rest) for x in (a[k] for k in places))


def test_unmarked_pages_lose_what_neighbours_share(spark):
    page = lambda k: f"<div>Site name</div><div>Body of {k}</div><div>Second line {k}</div><div>All rights reserved</div>"
    rows = [(k, f"http://h{k % 2}.org/p/{k}", page(k)) for k in range(40)] + [(100, None, None), (101, "http://alone/", page(101)), (102, "http://twin/a", page(7)), (103, "http://twin/b", page(7))]
    found = {r.page_id: r for r in html.report(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert all(found[k].text == f"Body of {k} Second line {k}" for k in range(40))
    assert (found[100].text, found[100].n_chars) == ("", 0)
    assert found[101].text.startswith("Site name") and found[102].text == found[103].text
    assert html.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
