"""Main text of web pages: nearest-URL page differencing, guided by the markup.

Each page is cut into lines (text blocks in page order), of three kinds:

* sure: the lines of a marked article (``article`` or ``main``);
* open: all lines of a page that marks none, and in an article those of elements that may or
  may not be text (``dialog``, ``button``, ``svg``; classes such as ``related`` or ``share``);
* outside: what else a page with a marked article shows.

Elements that are never main text (menus, footers, forms, scripts and so on, by tag, role
or a class that names one) give no lines at all. Open lines are decided by differencing:
pages are laid out in order of (host, path, id), and each is paired with the nearest page
before and after it on its host that differs from it, whatever runs of equal pages lie between. The
two pages' lines are aligned by longest common subsequence, and open lines on it are
deleted as the site's frame. Of the two neighbours that whose path shares the longer prefix is taken, unless
it is a copy: what the alignment leaves of both is nothing, or has half of its words in common. A copy tells
nothing, and the other is taken. Sure lines are kept: that a neighbour has a paragraph of an article too (a copy, a shared
passage) does not make it a frame.

The order is found by range partitioning of small rows, so that a hot host spreads over many
tasks; pages at the partitions' edges find their neighbours by one row a partition, so the
result does not depend on the partitioning. Lines travel only where a page has open ones.

Defined results: null or empty html has empty text; null url, or one without host: no neighbour; repeated
rows are equal pages, with the same neighbours; markup left open ends with the page (a skipped element also
where an article begins); other columns are ignored; an empty table gives no rows; each
page gives exactly one row. A line stands for its 64-bit hash.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_batches
from .url_filter import host, path

COPY_SHARE = 0.5
"""Share of words that what an alignment leaves of two copies has in common, at least."""
SURE, OPEN, OUTSIDE = range(3)
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("aside footer form head iframe menu nav noscript object option select template textarea audio video canvas".split())
RAW = frozenset("script style".split())
MARKED = frozenset("ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr notice notices comment comments disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead login signup pagination pager toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar form".split())
DOUBTED = frozenset("dialog button svg".split())
DOUBTED_WORDS = frozenset("alert banner copyright discussion legal modal newsletter overlay paywall popup promo promotion recommended related replies reply respond share sharing side social subscribe subscription widget".split())
DOUBTED_ROLES = frozenset("alert dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?i)(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z0-9]+")



def judged(tag: str, attrs: str, inside: bool) -> int:
    """If an element and all within it is main text (``SURE``, as far as this tells), perhaps (``OPEN``) or never (``OUTSIDE``)."""
    if tag in DROPPED or tag == "header" and not inside:
        return OUTSIDE
    kind = OPEN if tag in DOUBTED else SURE
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUTSIDE
        if name == "role":
            if value in ROLES:
                return OUTSIDE
            if value in DOUBTED_ROLES:
                kind = OPEN
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            words = _PART.split(value)
            if not MARKED.isdisjoint(words):
                return OUTSIDE
            if not DOUBTED_WORDS.isdisjoint(words):
                kind = OPEN
    return kind


def lines(html: str) -> list[tuple[str, int]]:
    """Text blocks in page order, with their kinds."""
    found: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    skip, depth, doubt, within, firm, inside, marked, at = "", 0, "", 0, False, [], False, 0

    def close() -> None:
        nonlocal firm
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, OPEN if not firm else SURE, bool(inside)))
        firm = False

    while (m := _TOKEN.search(html, at)) is not None:
        if not skip:
            piece = html[at : m.start()]
            parts.append(piece)
            firm = firm or not doubt and not piece.isspace() and piece != ""
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not ends:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        kind = SURE if ends else judged(tag, m[3], bool(inside) or tag in ("article", "main"))
        opens_article = tag in ("article", "main") and not ends and kind == SURE
        if skip:
            if opens_article and skip not in ("article", "main") and not inside:
                skip, depth = "", 0
            elif tag == skip:
                depth += -1 if ends else tag not in VOID and not m[3].endswith("/")
                if depth <= 0:
                    skip = ""
                continue
            else:
                continue
        if tag == "br":
            parts.append(" ")
            continue
        lasts = tag not in VOID and not m[3].endswith("/")
        if kind == OUTSIDE:
            if tag not in INLINE:
                close()
            if lasts:
                skip, depth = tag, 1
            continue
        if tag not in INLINE:
            close()
        if doubt and (opens_article or ends and tag in inside):
            doubt = ""
        if doubt == tag:
            within += -1 if ends else lasts
            if within <= 0:
                doubt = ""
        elif not doubt and kind == OPEN and lasts:
            doubt, within = tag, 1
        if opens_article:
            inside.append(tag)
            marked = True
        elif ends and tag in inside:
            while inside.pop() != tag:
                pass
    if not skip:
        parts.append(html[at:])
        firm = firm or not doubt and html[at:].strip() != ""
    close()
    return [(text, OUTSIDE if marked and not here else kind if marked else OPEN) for text, kind, here in found]


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places, in ``a`` and in ``b``, of one longest common subsequence.

    Equal ends are cut off; the rest goes through the bit-parallel recurrence (a row of bits for each
    line of ``b``), of which every so many rows are kept and the others made again on the way
    back: equal lines cost no more than others, and memory grows with ``n ** 1.5`` bits.
    """
    low, top = 0, min(len(a), len(b))
    while low < top and a[low] == b[low]:
        low += 1
    end = 0
    while end < top - low and a[-1 - end] == b[-1 - end]:
        end += 1
    both = set(a[low : len(a) - end]).intersection(b[low : len(b) - end])
    x = [i for i in range(low, len(a) - end) if a[i] in both]
    y = [j for j in range(low, len(b) - end) if b[j] in both]
    found = [(i, i) for i in range(low)]
    found += ((x[i], y[j]) for i, j in reversed(list(_backwards([a[i] for i in x], [b[j] for j in y]))))
    return found + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


def _backwards(a: list, b: list) -> Iterator[tuple[int, int]]:
    if not a or not b:
        return
    masks: dict = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    full, step = (1 << len(a)) - 1, int(len(b) ** 0.5) + 1

    def rows(v: int, lines: list) -> Iterator[int]:
        for line in lines:
            u = v & masks[line]
            v = ((v + u) | (v - u)) & full
            yield v

    kept, v = [full], full
    for at in range(0, len(b), step):
        for v in rows(v, b[at : at + step]):
            pass
        kept.append(v)
    col, row, held, first = len(a), len(b), [], len(b) + 1
    while row and col:
        if row - 1 < first:
            first = (row - 1) // step * step
            held = [kept[first // step], *rows(kept[first // step], b[first : first + step])]
        if held[row - first] >> (col - 1) & 1:
            col -= 1
            continue
        row -= 1
        if held[row - first] >> (col - 1) & 1:
            col -= 1
            yield col, row


Page = tuple[list[int], bytes, list[str]]
"""Hashes of all lines, their kinds, and the texts of those that are not outside."""


def rest(page: Page, shared: set[int], kept: int = -1) -> list[str]:
    """Texts of the lines that are not shared; of shared ones, those of the kind ``kept``."""
    marks, kinds, found = page
    places = [i for i, k in enumerate(kinds) if k != OUTSIDE]
    return [t for i, t in zip(places, found, strict=True) if i not in shared or kinds[i] == kept]


def alike(a: list[str], b: list[str]) -> bool:
    """If what is left of two pages is that of copies."""
    x, y = (Counter(chain.from_iterable(t.split() for t in texts)) for texts in (a, b))
    return (x & y).total() >= COPY_SHARE * (x | y).total()


def differenced(own: Page, neighbours: list[Page]) -> list[str]:
    """The texts of ``own`` without the open lines that it shares, in order, with the first neighbour that is not a copy."""
    for other in neighbours:
        pairs = common_lines(own[0], other[0])
        shared = {i for i, _ in pairs}
        if not alike(rest(own, shared), rest(other, {j for _, j in pairs})):
            return rest(own, shared, SURE)
    return own[2]


PARSED = "page_id long, url string, host string, path string, digest long, open boolean, marks array<long>, kinds binary, texts array<string>"


def parsed(pages: DataFrame) -> DataFrame:
    """The lines of every page; a map."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    schema = pa.schema([("digest", pa.int64()), ("open", pa.bool_()), ("marks", pa.list_(pa.int64())), ("kinds", pa.binary()), ("texts", pa.list_(pa.string()))])
    signed = lambda h: h - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4):
                out = []
                for html in part.column(4).to_pylist():
                    found = lines(html)
                    marks = [signed(xxhash.xxh3_64_intdigest(t)) for t, _ in found]
                    kinds = bytes(k for _, k in found)
                    digest = xxhash.xxh3_64_intdigest(array("q", marks).tobytes() + kinds)
                    out.append((signed(digest), OPEN in kinds, marks, kinds, [t for t, k in found if k != OUTSIDE]))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True))], ["page_id", "url", "host", "path", *schema.names])

    return rows.mapInArrow(run, PARSED)


LINKS = "part int, rid long, before long, after long, first boolean, last boolean, host string, path string, page_id long, digest long, begin_rid long, end_host string, end_digest long, end_rid long, second_host string, second_rid long, inner_host string, inner_rid long"


def links(rows: DataFrame) -> DataFrame:
    """``rid, before, after``: the nearest page before and after each on its host that differs from it. rows: ``rid, host, path, page_id, digest``."""
    laid = rows.where("host <> ''").repartitionByRange("host", "path", "page_id", "digest").sortWithinPartitions("host", "path", "page_id", "digest")
    names = [x.split()[0] for x in LINKS.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in LINKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, edge, run_of, held, before, first = TaskContext.get().partitionId(), {}, None, array("q"), None, True
        out: list[tuple] = []

        def rows_of(after: int | None, last: bool) -> Iterator[pa.RecordBatch]:
            """The held run's rows."""
            for at in range(0, len(held), 10_000):
                ids = held[at : at + 10_000]
                n = len(ids)
                given = {"part": [part] * n, "rid": ids, "before": [before] * n, "after": [after] * n, "first": [first] * n, "last": [last] * n}
                yield pa.RecordBatch.from_arrays([pa.array(given.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

        end = None
        for batch in batches:
            for rid, h, p, page, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run_of != (h, digest):
                    if run_of is not None:
                        yield from rows_of(rid if h == run_of[0] else None, False)
                        if first:
                            edge |= {"second_host": h, "second_rid": rid}
                        before, first = end if h == run_of[0] else None, False
                        edge |= {"inner_host": run_of[0], "inner_rid": end}
                        held = array("q")
                    else:
                        edge |= {"part": part, "host": h, "path": p, "page_id": page, "digest": digest, "begin_rid": rid}
                    run_of = (h, digest)
                held.append(rid)
                end = rid
        if run_of is not None:
            yield from rows_of(None, True)
            edge |= {"end_host": run_of[0], "end_digest": run_of[1], "end_rid": end}
            yield pa.RecordBatch.from_arrays([pa.array([edge.get(f.name)], f.type) for f in schema], schema=schema)

    found = materialize(laid.select("rid", "host", "path", "page_id", "digest").mapInArrow(run, LINKS), "links")
    edges = found.where("rid is null").select(*(n for n in names if n not in ("rid", "before", "after", "first", "last"))).collect()  # a row a partition
    at = found.sparkSession.createDataFrame(between(edges), "part int, far_before long, far_after long")
    found = found.where("rid is not null").join(F.broadcast(at), "part")  # a row a partition
    return found.select("rid", F.when(F.col("first"), F.col("far_before")).otherwise(F.col("before")).alias("before"), F.when(F.col("last"), F.col("far_after")).otherwise(F.col("after")).alias("after"))


def between(edges: list) -> list[tuple[int, int | None, int | None]]:
    """For each partition the page before its first run of equal pages, and the page after its last."""
    order = sorted(edges, key=lambda e: (e.host, e.path, e.page_id is not None, e.page_id or 0, e.digest))
    far_before, far_after = {}, {}
    run = end = inner = None  # the run that the partitions so far end with, its last page, and the last page before it on its host
    for e in order:
        if run is not None and run[0] == e.host:
            far_before[e.part] = inner if run == (e.host, e.digest) else end
        if e.second_rid is not None:
            inner = e.inner_rid if e.inner_host == e.end_host else None
        else:
            inner = far_before.get(e.part)
        run, end = (e.end_host, e.end_digest), e.end_rid
    run = begin = inner = None  # the run that the partitions so far begin with, seen from the end
    for e in reversed(order):
        if run is not None and run[0] == e.end_host:
            far_after[e.part] = inner if run == (e.end_host, e.end_digest) else begin
        if e.second_rid is not None:
            inner = e.second_rid if e.second_host == e.host else None
        else:
            inner = far_after.get(e.part)
        run, begin = (e.host, e.digest), e.begin_rid
    return [(e.part, far_before.get(e.part), far_after.get(e.part)) for e in order]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    rows = materialize(parsed(pages).withColumn("rid", F.monotonically_increasing_id()), "lines")
    asks = F.col("open") & (F.col("host") != "")
    out = rows.where(~asks).select("page_id", "url", F.array_join("texts", "\n\n").alias("text"))
    asked = rows.where(asks)
    if not asked.isEmpty():
        near = materialize(links(rows).join(asked.select("rid"), "rid", "left_semi"), "near")
        needed = near.select(F.explode(F.array("before", "after")).alias("rid")).where("rid is not null").distinct()
        page = F.struct("path", "marks", "kinds", "texts")
        held = materialize(rows.join(needed, "rid", "left_semi").select("rid", page.alias("page")), "held")
        paired = asked.join(near, "rid", "left")
        for side in ("before", "after"):
            other = held.select(F.col("rid").alias(side), F.col("page").alias(f"page_{side}"))
            paired = paired.withColumn(side, F.coalesce(side, -1 - F.col("rid"))).join(other, side, "left")  # a key of its own where there is none
        out = out.unionByName(decided(paired))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def decided(paired: DataFrame) -> DataFrame:
    """``page_id, url, text`` of pages with their neighbours, by differencing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for p, marks, kinds, texts, *sides in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                near = sorted((x for x in sides if x is not None), key=lambda x: -len(commonprefix([x["path"], p])))
                found.append("\n\n".join(differenced((marks, kinds, texts), [(x["marks"], x["kinds"], x["texts"]) for x in near])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])

    return paired.select("page_id", "url", "path", "marks", "kinds", "texts", "page_before", "page_after").mapInArrow(run, "page_id long, url string, text string")
