"""Differencing of unmarked pages: runs of copies, short pages, and the same text for any number of partitions."""

from tablelens.llm import html

SCHEMA = "page_id long, url string, html string"


def page(*lines):
    return "".join(f"<div>{x}</div>" for x in ("Menu", "Site name", *lines, "Imprint", "Terms", "All rights reserved"))


def texts(spark, rows):
    return {r.page_id: r.text for r in html.report(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_runs_of_copies_and_short_pages(spark):
    rows = [(k, f"http://h/a?ref={k}", page("Body a", "More of a")) for k in range(6)]
    rows += [(10 + k, f"http://h/b{k}", page(f"Body {k}")) for k in range(3)]
    rows += [(20, "http://x/a", page("Long one", "with an end")), (21, "http://x/b", page("Long one")), (22, "http://x/c", page("Other"))]
    found = texts(spark, rows)
    assert all(found[k] == "Body a More of a" for k in range(6))
    assert all(found[10 + k] == f"Body {k}" for k in range(3))
    assert (found[20], found[21]) == ("Long one with an end", "Long one")  # an excerpt is passed over


def test_partitions_do_not_matter(spark, monkeypatch):
    rows = [(k, f"http://h{k // 3}/p{k}", page(f"Body {k}")) for k in range(60)]
    assert len(set(map(str, ({k: f"Body {k}" for k in range(60)}, *(_with(spark, monkeypatch, n, rows) for n in (1, 7, 40)))))) == 1


def _with(spark, monkeypatch, partitions, rows):
    monkeypatch.setattr(html, "parallelism", lambda df: partitions)
    monkeypatch.setattr(html, "TOGETHER", 4)
    return dict(sorted(texts(spark, rows).items()))


def brute(rows):
    """Texts of unmarked pages whose lines outside of the site's are all different: what two of the nearest pages share goes."""
    pages = {}
    for k, url, lines in rows:
        host, path = url.split("://")[1].split("/", 1)
        pages.setdefault(host, {}).setdefault(tuple(lines), []).append((path.split("?")[0], k))
    out = {}
    for found in pages.values():
        ordered = sorted((min(p for p, _ in where), lines) for lines, where in found.items())
        for at, (_, lines) in enumerate(ordered):
            near = [ordered[i][1] for i in (at - 2, at - 1, at + 1, at + 2) if 0 <= i < len(ordered)]
            keep = [x for x in lines if sum(x in other for other in near) < min(2, len(near))] if near else list(lines)
            out.update({k: " ".join(keep) for _, k in found[lines]})
    return out


def test_whole_reports_against_brute_force(spark, monkeypatch):
    rows, number = [], 0
    for host in range(6):
        menu = [f"Menu of {host}", f"About site {host}"]
        for page_ in range(3 + 7 * host):
            extra = [f"Section {page_ // 4} of {host}"]
            body = [f"Body {host} {page_} {i} with words" for i in range(1 + page_ % 4)]
            for copy in range(1 + (page_ % 5 == 0)):
                rows.append((number, f"http://h{host}/p{page_:03d}?ref={copy}", [*menu, *extra, *body, "Imprint"]))
                number += 1
    table = [(k, url, "".join(f"<div>{x}</div>" for x in lines)) for k, url, lines in rows]
    expected = brute(rows)
    monkeypatch.setattr(html, "TOGETHER", 5)
    assert texts(spark, table) == expected


def test_near_copies_keep_their_article(spark):
    article = [f"Sentence {k} of the same long article" for k in range(8)]
    rows = [(0, "http://h/a1", page(*article, "share A")), (1, "http://h/a2", page(*article, "print B"))]
    rows += [(2 + k, f"http://h/b{k}", page(f"Other body {k}")) for k in range(4)]
    found = texts(spark, rows)
    assert found[0] == " ".join([*article, "share A"]) and found[1] == " ".join([*article, "print B"])
    assert all(found[2 + k] == f"Other body {k}" for k in range(4))
    two = [(0, "http://h/a1", page(*article, "share A")), (1, "http://h/a2", page(*article, "print B"))]
    assert all(article[0] in t for t in texts(spark, two).values())  # alone on their host, copies say nothing about it


def test_a_long_run_of_near_copies_hides_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(html, "TOGETHER", 16)
    article = [f"Sentence {k} of the same long article" for k in range(6)]
    rows = [(k, f"http://h/m{k:03d}", page(*article, f"own line {k}")) for k in range(90)]
    rows += [(100 + k, f"http://h/{c}{k:03d}", page(f"Body {c} {k}")) for c in "az" for k in range(0, 60)]
    rows = [(n, u, h) for n, (_, u, h) in enumerate(rows)]
    found = texts(spark, rows)
    assert all(found[k] == " ".join([*article, f"own line {k}"]) for k in range(90))
    assert all(found[k].startswith("Body ") and "Menu" not in found[k] for k in range(90, len(rows)))


def test_links_in_marked_articles_go_if_neighbours_share_them(spark):
    def marked(k):
        return f"<p>Site</p><article><p>Text {k}</p><p>Passage of all</p><p><a href='/x'>Share</a> <a href='/y'>Print</a></p><p>See <a href='/z'>this</a></p></article><p>Foot</p>"

    found = texts(spark, [(k, f"http://h/{k}", marked(k)) for k in range(6)])
    assert all(found[k] == f"Text {k} Passage of all See this" for k in range(6))
    assert texts(spark, [(0, "http://h/0", marked(0))])[0] == "Text 0 Passage of all Share Print See this"


def test_many_partitions(spark, monkeypatch):
    rows = [(k, f"http://h{k % 2}/p{k}", page(f"Body {k}")) for k in range(40)]
    monkeypatch.setattr(html, "parallelism", lambda df: 300)
    assert texts(spark, rows) == {k: f"Body {k}" for k in range(40)}
