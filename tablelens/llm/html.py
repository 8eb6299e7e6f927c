"""Main text of web pages by differencing them with the pages nearest by URL.

A page becomes lines, one per block.  Scripts, styles, navigation, headers,
footers, asides, forms, hidden parts and elements whose class or role says
notice, advert, sidebar, menu or comment never become lines.

Every page is paired with the nearest different pages of its host, up to two on
each side in the order of their paths, and a longest common subsequence aligns
its lines with theirs.  Markup says how much evidence a shared line needs:

* On a page without a marked article (an article or main element, or a class
  that says so) a line that two of the neighbours share (one, if there is only
  one) belongs to the site and is deleted.
* In a marked article, text stays: what articles share are passages of theirs.
  A line that is nothing but links goes if two neighbours share it.
* Lines outside of the marked article are the site's whatever neighbours say.

A near copy says nothing about the site.  Lines that more than half of the
pages of a host hold are set apart; pages are copies if half of what is left of
one is aligned with the other's, or if one has no line of its own.  With less
than four pages a host has no such majority: there, two pages are copies if
they share four fifths of both, unless this is little text of a host of three.
Runs of copies are collapsed to their first page before neighbours are looked
for, so the nearest different page is found however long the run is.

Lines are compared by 64-bit digests; texts do not move.  Equal pages of a host
are one page.  Character references are decoded, white space in a block is one
space, blocks are joined by one space.  Null html has the text "".  Pages
without url are of one host and path.  Partitions change nothing but where runs
of copies are cut.  Repeated rows are copies.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import fresh, materialize, parallelism, utf8

# Different pages on each side that a page is aligned with, distinct ones among which they are sought, pages aligned together.
NEIGHBOURS, REACH, TOGETHER = 2, 4, 2048
# How many neighbours have to share a line.
EVIDENCE = 2
# Share of characters from which two pages are copies: of what the host's majority leaves, and of the whole in hosts of few pages.
COPY, COPY_OF_FEW, FEW, LITTLE = 0.5, 0.8, 4, 500
# What a line is: outside of the marked article, text in it, nothing but links in it.
OUTSIDE, ARTICLE_TEXT, ARTICLE_LINKS = 0, 1, 2

# Elements by what they are.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt rtc ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav footer aside form button select dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead header cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus reply replies share sharing social related recommended recommendations pagination pager toolbar widget".split()
)
KEEPERS = frozenset("html body main article".split())
ARTICLE = frozenset("article articlebody article-body article-content post-content entry-content post-body story story-body main-content".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _names(attributes: dict[str, str]) -> list[str]:
    return f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split()


def _is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    if tag in KEEPERS:
        return tag == "article" and any(m in MARKS and m.startswith(("comment", "repl")) for n in _names(attributes) for m in re.split("[-_]", n))
    if tag in DROPPED or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    for name in _names(attributes):
        parts = re.split("[-_]", name)
        if {"has", "no", "with", "without"} & set(parts):
            continue
        if any(p in MARKS for p in parts) and not (in_article and parts[-1] == "header"):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, int]]:
    """The lines of a page outside of what markup drops, each with what it is."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in article
    text: list[str] = []
    links = plain = 0  # open links, and pieces of text outside of links

    def flush() -> None:
        nonlocal plain
        line = " ".join("".join(text).split())
        if line:
            inside = bool(stack) and stack[-1][2]
            out.append((line, OUTSIDE if not inside else ARTICLE_TEXT if plain else ARTICLE_LINKS))
        text.clear()
        plain = 0

    def add(piece: str) -> None:
        nonlocal plain
        text.append(piece)
        plain += not links and not piece.isspace()

    def close(k: int) -> None:
        if any(t not in INLINE for t, _, _ in stack[k:]):
            flush()
        nonlocal links
        links -= sum(s[0] == "a" for s in stack[k:])
        del stack[k:]

    def close_last(tags: tuple[str, ...], until: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                close(k)
                return
            if stack[k][0] in until:
                return

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            if not (stack and stack[-1][1]):
                add(entities.unescape(page[at:]))
            break
        if m.start() > at and not (stack and stack[-1][1]):
            add(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^a-zA-Z0-9]", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            if end:
                at = page.find(">", end.start()) + 1 or len(page)
            continue
        if tag in VOID:
            if tag == "br" or tag not in INLINE:
                text.append(" ")
                if tag == "hr":
                    flush()
            continue
        attributes = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3] or "") for a in _ATTRIBUTE.findall(m[3])} if m[3].strip("/ \n\t\r") else {}
        if tag in ("article", "main") and stack and stack[-1][1] and not _is_dropped(tag, attributes, False):
            # What was left open before the article ends here.
            close(next(k for k, s in enumerate(stack) if s[1]))
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P:
            close_last(("p",), frozenset(("table", "td", "th", "button", "article", "section", "div")))
        if tag in SELF_CLOSING:
            close_last(SELF_CLOSING[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        dropped = dropped or _is_dropped(tag, attributes, inside)
        marked = tag in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        inside = not dropped and (inside or marked or any(n in ARTICLE for n in _names(attributes)))
        stack.append((tag, dropped, inside))
        links += tag == "a"
    flush()
    return out


def common_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel dynamic programming."""
    where: dict = {}
    for k, line in enumerate(a):
        where[line] = where.get(line, 0) | 1 << k
    full = (1 << len(a)) - 1
    rows, v = [], full
    for line in b:  # zero bits of v mark where the length of the best alignment grows
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i = set(), len(a) - 1
    for j in range(len(b) - 1, -1, -1):
        before = rows[j - 1] if j else full
        # The last growing place up to i in this row; if it is none in the row before, lines i and j are a pair.
        while i >= 0 and rows[j] >> i & 1:
            i -= 1
        if i < 0:
            break
        if before >> i & 1 and a[i] == b[j]:
            found.add(i)
            i -= 1
    return found


@dataclass
class Page:
    """A page as digests of its lines, their lengths and kinds, and which ones the host's majority holds."""

    host: str
    lines: list[int]
    sizes: list[int]
    kinds: list[int]
    common: frozenset[int]
    pages: int

    def weight(self, places: Collection[int] | None = None) -> int:
        return sum(self.sizes) if places is None else sum(self.sizes[k] for k in places)

    def own(self) -> list[int]:
        return [k for k, line in enumerate(self.lines) if line not in self.common]


def are_copies(a: Page, b: Page, shared: Collection[int]) -> bool:
    """Whether pages of one host are near copies; ``shared``: the lines of ``a`` that are aligned with some of ``b``."""
    if len(shared) >= min(len(a.lines), len(b.lines)):
        return True
    if a.pages < FEW:
        both = a.weight(shared)
        return both >= COPY_OF_FEW * max(a.weight(), b.weight()) and (a.pages == 2 or both >= LITTLE)
    left, right = a.weight(a.own()), b.weight(b.own())
    return a.weight([k for k in shared if a.lines[k] not in a.common]) >= COPY * min(left, right) > 0


def deleted_lines(page: Page, sides: list[list[Page]]) -> list[int]:
    """The lines that belong to the site, by the nearest different ones of the pages on each side, the nearest first."""
    votes = np.zeros(len(page.lines), np.int64)
    seen = 0
    for side in sides:
        found = 0
        for other in side:
            if found == NEIGHBOURS or other.host != page.host:
                break
            shared = common_lines(page.lines, other.lines)
            if not are_copies(page, other, shared):
                votes[list(shared)] += 1
                found += 1
        seen += found
    if not seen:
        return []
    marked = any(k != OUTSIDE for k in page.kinds)
    need = np.where(np.array(page.kinds) == ARTICLE_LINKS, EVIDENCE, min(EVIDENCE, seen))
    able = np.array([k == (ARTICLE_LINKS if marked else OUTSIDE) for k in page.kinds], bool)
    return np.flatnonzero(able & (votes >= need)).tolist()


def main_text(lines: list[tuple[str, int]], deleted: Collection[int] = ()) -> str:
    """The lines of the marked article, or of a page without one, but for those deleted."""
    marked = any(kind for _, kind in lines)
    return " ".join(line for k, (line, kind) in enumerate(lines) if (kind or not marked) and k not in deleted)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _parsed(raw: pa.Scalar) -> list[tuple[str, int]]:
    return lines_of(raw.as_py().decode("utf-8", "replace"))


def _digests(lines: list[tuple[str, int]]) -> tuple[list[int], int]:
    """A digest of each line, and one of the page: its lines and what they are."""
    each = np.array([xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) for line, _ in lines], np.uint64).view(np.int64)
    kinds = bytes(kind for _, kind in lines)
    return each.tolist(), int(np.uint64(xxhash.xxh3_64_intdigest(each.tobytes() + kinds)).view(np.int64))


_SKETCH = "host string, path string, page long, lines array<long>, sizes array<int>, kinds array<int>"


def _sketches(placed: DataFrame) -> DataFrame:
    """The pages (host, path, raw) with lines as ``_SKETCH``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, p, r in zip(*batch.columns, strict=True):
                lines = _parsed(r)
                if lines:
                    each, page = _digests(lines)
                    rows.append((h.as_py(), p.as_py(), page, each, [len(line) for line, _ in lines], [kind for _, kind in lines]))
            types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _SKETCH.split(", ")])

    return placed.mapInArrow(run, _SKETCH)


def _hosts(pages: DataFrame) -> DataFrame:
    """(host, pages, common): how many distinct pages a host has, and the lines that more than half of them hold."""
    size = materialize(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host-sizes")
    held = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    held = materialize(held.where("n > 1"), "repeated-lines")  # a page alone on its host has no neighbours
    # At most twice as many lines as a page of the host has on average.
    many = held.join(size, "host").where(F.col("n") * 2 > F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("common"))
    return size.join(many, "host", "left").select("host", "pages", F.coalesce("common", F.array().cast("array<long>")).alias("common"))


def _numbered(rows: DataFrame, by: list[str], into: str) -> DataFrame:
    """``rows`` in order, with their number from 0; partitions are in order, and so are the rows of each."""
    ordered = rows.repartitionByRange(parallelism(rows), *by).sortWithinPartitions(*by)
    ordered = materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "ordered-pages")
    block, within = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    starts = ordered.groupBy(block.alias("block")).count().select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return ordered.withColumn("block", block).join(F.broadcast(starts), "block").withColumn(into, F.col("start") + within).drop("block", "number", "start")


def _page(host: str, lines: list[int], sizes: list[int], kinds: list[int], common: list[int], pages: int) -> Page:
    return Page(host, lines, sizes, kinds, frozenset(common), pages)


_FIELDS = ["host", "lines", "sizes", "kinds", "common", "pages"]


def _first_of_runs(ordered: DataFrame, at: str) -> DataFrame:
    """(at): the pages that are no copies of the first page of the run before them; rows come in order of ``at``."""
    placed = ordered.repartitionByRange(parallelism(ordered), at).sortWithinPartitions(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in batches:
            kept = []
            for number, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = _page(*fields)
                if first is None or first.host != page.host or not are_copies(page, first, common_lines(page.lines, first.lines)):
                    first = page
                    kept.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], [at])

    return placed.select(at, *_FIELDS).mapInArrow(run, f"{at} long")


def differenced(pages: DataFrame) -> DataFrame:
    """(host, page, deleted): the lines that belong to the site, of all distinct pages that have some; ``pages``: as ``_SKETCH``."""
    one = pages.groupBy("host", "page").agg(F.min(F.struct("path", "lines", "sizes", "kinds")).alias("of"))
    one = materialize(one.select("host", "page", "of.path", "of.lines", "of.sizes", "of.kinds"), "distinct-pages")
    placed = materialize(_numbered(one.join(materialize(_hosts(one), "hosts"), "host"), ["host", "path", "page"], "at"), "numbered-pages")
    firsts = materialize(_first_of_runs(placed, "at"), "first-of-runs")
    # Where partitions cut a run, its parts meet in the second round.
    firsts = materialize(_first_of_runs(placed.join(firsts, "at", "left_semi"), "at"), "first-of-runs")
    group = F.floor(F.col("at") / TOGETHER)
    kept = placed.select("at", "page", *_FIELDS).withColumn("group", group).withColumn("asked", F.lit(True))
    kinds = materialize(_numbered(firsts, ["at"], "run").withColumn("group", group), "runs")
    # The runs next to each group of pages, on both sides, from one row per group.
    spans = kinds.groupBy("group").agg(F.min("run").alias("least"), F.max("run").alias("most"))
    groups = kept.select("group").distinct().join(spans, "group", "left")
    upto = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("last", F.coalesce(F.max("most").over(upto), F.lit(-1)))
    near = groups.select("group", F.explode(F.array_distinct(F.concat(
        F.sequence(F.coalesce("least", F.col("last") + 1) - REACH - 1, F.coalesce("least", F.col("last") + 1) - 1),
        F.sequence(F.col("last") + 1, F.col("last") + REACH),
    ))).alias("run"))
    outer = near.join(kinds.select("run", "at"), "run").select("group", "at").join(placed.select("at", "page", *_FIELDS), "at")
    rows = kept.join(kinds.select("at", F.lit(True).alias("first")), "at", "left").select("group", "at", "page", *_FIELDS, "asked", F.coalesce("first", F.lit(False)).alias("first"))
    outer = outer.select("group", "at", "page", *_FIELDS, F.lit(False).alias("asked"), F.lit(True).alias("first"))
    meeting = rows.unionByName(outer).repartition(parallelism(pages), "group").sortWithinPartitions("group", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            firsts = [r[2] for r in rows if r[4]]
            before, out = 0, []
            for _, name, page, asked, first in rows:
                before += first  # pages of runs up to and with this one's
                if asked:
                    earlier = firsts[max(0, before - 1 - REACH) : before][::-1]
                    gone = deleted_lines(page, [earlier, firsts[before : before + REACH]])
                    if gone:
                        out.append((page.host, name, gone))
            columns = zip(*out, strict=True) if out else [[]] * 3
            types = (pa.string(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["host", "page", "deleted"])

        held: list[tuple] = []
        for batch in batches:
            for g, at, name, *fields, asked, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != g:
                    yield found(held)
                    held = []
                held.append((g, name, _page(*fields), asked, first))
        if held:
            yield found(held)

    return meeting.mapInArrow(run, "host string, page long, deleted array<int>")


def extract(pages: DataFrame, into: str = "main_text", url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the html) of ``pages`` with the main text in ``into``."""
    keep = [c for c in pages.columns if c not in (html_col, into)] if keep is None else keep
    host, key, lines = (fresh(pages, n) for n in ("page_host", "page_key", "page_lines"))
    url, raw = F.col(f"`{url_col}`"), utf8(F.col(f"`{html_col}`"))
    placed = pages.select(host_of(url).alias("host"), path_of(url).alias("path"), raw.alias("raw"))
    gone = materialize(differenced(materialize(_sketches(placed), "page-lines")), "lines-of-sites")
    kept = [F.col(f"`{c}`") for c in keep]
    rows = pages.select(*kept, host_of(url).alias(host), raw.alias(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, all_ = [], [], []
            for r in batch.column(len(keep) + 1):
                found = _parsed(r)
                marked = any(kind for _, kind in found)
                open_ = any(kind == ARTICLE_LINKS for _, kind in found) if marked else bool(found)  # may lose lines
                texts.append(main_text(found))
                keys.append(_digests(found)[1] if open_ else None)
                all_.append([line if kind or not marked else None for line, kind in found] if open_ else None)
            arrays = [*batch.columns[: len(keep) + 1], pa.array(keys, pa.int64()), pa.array(all_, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, host, key, lines, into])

    out = rows.mapInArrow(run, rows.select(*kept, host).schema.add(key, "long").add(lines, ArrayType(StringType())).add(into, "string"))
    # Pages that lose nothing have keys of their own, so they are dealt evenly.
    out = out.withColumn(host, F.when(F.col(key).isNull(), F.monotonically_increasing_id().cast("string")).otherwise(F.col(host)))
    o, g = out.alias("o"), gone.alias("g")
    joined = o.join(g, (F.col(f"o.{key}") == F.col("g.page")) & (F.col(f"o.{host}") == F.col("g.host")), "left")
    rest = F.filter(F.col(f"o.{lines}"), lambda x, k: x.isNotNull() & ~F.array_contains("g.deleted", k))
    text = F.when(F.col("g.deleted").isNull(), F.col(f"o.`{into}`")).otherwise(F.array_join(rest, " "))
    return joined.select(*[F.col(f"o.`{c}`") for c in keep], text.alias(into))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    found = extract(pages.select("page_id", "url", "html"), "text")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
