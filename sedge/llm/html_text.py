"""Main text of web pages: nearest-URL page differencing, with markup that protects the article.

A page is read once by a small tokenizer into lines, one for each block of text. Every page is then
compared with its nearest neighbour: pages are sorted by host and URL path, of the two next to a page
(of the same host) the one with the longer common path counts, the lines of both are aligned by a
longest common subsequence and the lines that they share are deleted.

Markup says what a line may be. Menus, headers, footers, sidebars, notices, adverts, forms,
comments, scripts and the like (by tag, role or words of class and id that say nothing else) are no
lines at all. If the page says where its article is (article, main or role main), lines there are
protected: differencing alone would also delete what copies of an article, or passages that articles
quote, have in common. Lines outside the article then only serve the comparison. Under a class that
holds such a word beside others ("related-work") a line is a suspect: it goes if it is shared.
Pages without an article keep all lines that are not shared.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedge.llm import common

_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)""")
_ATTR = re.compile(r"""([a-zA-Z:_-][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_DROP = {"nav", "aside", "footer", "button", "select", "dialog", "menu", "template", "svg", "canvas", "object", "audio", "video", "head", "math", "fieldset", "datalist"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup share sharing social sidebar related recommended recommendations trending popular comment comments commentlist disqus replies reply respond footer nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager toolbar topbar masthead login widget copyright disclaimer skip".split()
)
#: Words that may stand beside those in a class that says nothing else ("comment-list").
_PLAIN = set("area bar block body bottom box button buttons card container content desktop elem group header icons inner item items left link links list main mobile module outer page panel post posts row section site slot small text title top unit wrap wrapper zone right".split())
_OTHERS = set("related recommended recommendations trending popular comment comments commentlist disqus replies reply respond".split())
_HEADS = {"header", "masthead", "topbar"}
_SPACES = re.compile(r"\s+")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") if v else "" for k, v in _ATTR.findall(text)}


def _kind(tag: str, attrs: str, inside: bool) -> tuple[str, bool, set[str], bool]:
    """'drop' or '', whether it is an article or main, the words of class and id that speak against
    it, and whether there are such words beside others. inside: in an article already, where a
    header is the article's own and a form is dropped."""
    if tag in _DROP or tag == "header" and not inside or tag == "form" and inside:
        return "drop", False, set(), False
    role, against, suspect = "", {"form"} if tag == "form" else set(), False
    if attrs.strip():
        got = _attributes(attrs)
        role = got.get("role", "").lower()
        style = got.get("style", "").replace(" ", "").lower()
        if tag not in ("body", "html"):
            if role in _ROLES and tag != "form" or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in style:
                return "drop", False, set(), False
            for name in f"{got.get('class', '')} {got.get('id', '')}".split():
                words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w}
                bad = words & _WORDS or (set() if inside else words & _HEADS)
                if words <= _WORDS | _PLAIN:
                    against |= bad
                else:
                    suspect |= bool(bad)
    return "", tag in ("article", "main") or role == "main", against, suspect


#: What a line of a page is: of no article; of the article; suspect; beside the article.
FREE, SAFE, SUSPECT, OUTSIDE = range(4)


def _end_of_tag(html: str, at: int) -> int:
    """Where the tag ends whose attributes were read up to `at`: behind its ">". A quote that never
    closes is no quote."""
    if at >= len(html):
        return at
    close = html.find(">", at)
    return close + 1 if close >= 0 else len(html)


def blocks(html: str) -> tuple[list[str], list[int]]:
    """The page's lines in order, and what each of them is."""
    found: list[tuple] = []  # text, elements around it with words against it, in an article, may join main, in either, suspect
    stack: list[tuple] = []
    depth: dict[str, int] = {}  # open elements of each tag
    # inside: articles and mains within the innermost element that has words against it
    # open_p: where in the stack a p is open with nothing but inline elements in it, or -1
    drop = level = inside = articles = mains = 0
    others = suspect = False
    open_p = -1
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACES.sub(" ", unescape("".join(buffer))).strip()
            buffer.clear()
            if text and not drop and (inside or not level):
                found.append((text, level, articles > 0, mains > 0 and not others, inside > 0, suspect))

    def pop() -> None:
        nonlocal drop, level, inside, articles, mains, others, suspect, open_p
        tag, (drop, level, inside, articles, mains, others, suspect, open_p) = stack.pop()
        depth[tag] -= 1

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not drop:
                buffer.append(html[at:lt])
            at = lt
            continue
        if skip := _OTHER.match(html, at):
            at = skip.end()
            continue
        m = _TAG.match(html, at)
        if not m:
            if not drop:
                buffer.append("<")
            at += 1
            continue
        at = _end_of_tag(html, m.end())
        attrs = html[m.end(2) : at].removesuffix(">")
        tag = m[2].lower()
        if tag not in _INLINE and tag != "br":
            flush()
        if m[1]:
            if depth.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = _end_of_tag(html, end.start()) if end else n
            continue
        if tag in _CLOSES_P:
            if open_p >= 0:
                at_p = open_p
                while len(stack) > at_p:
                    pop()
        elif tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == tag:
            pop()
        elif tag == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if attrs.endswith("/") and tag in ("svg", "math"):
            continue
        kind, is_main, against, doubt = _kind(tag, attrs, inside > 0)
        stack.append((tag, (drop, level, inside, articles, mains, others, suspect, open_p)))
        depth[tag] = depth.get(tag, 0) + 1
        open_p = len(stack) - 1 if tag == "p" else open_p if tag in _INLINE else -1
        if kind == "drop" or against and articles:
            drop += 1
            continue
        suspect |= doubt
        if against:
            level, inside, others = level + 1, 0, others or bool(against & _OTHERS)
        if is_main:
            suspect, inside = suspect and inside > 0, inside + 1
            articles += tag == "article"
            mains += tag != "article"
    flush()
    if not any(x[4] for x in found):
        return [x[0] for x in found], [SUSPECT if x[5] else FREE for x in found]
    least = min(x[1] for x in found if x[4])
    if any(x[1] == least and x[2] for x in found if x[4]):
        inner = least
    else:  # a main without an article of its own: with those that wrappers in it hold
        inner = min((x[1] for x in found if x[4] and x[2] and x[3]), default=least)
    safe = [x[4] and (x[1] == least or x[1] == inner and x[2] and x[3]) for x in found]
    return [x[0] for x in found], [(SUSPECT if x[5] else SAFE) if ok else OUTSIDE for x, ok in zip(found, safe)]


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b.

    Equal ends are cut off first, then lines that only one side has. The rest is done by whole rows
    of the table, each an integer with a bit for each line of b; every k-th row is kept and the rows
    between two are made again on the way back, so memory grows with len(b) * sqrt(len(a)) / 8
    and time with len(a) * len(b) / 64, however often a line repeats.
    """
    head, end = 0, min(len(a), len(b))
    while head < end and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < end - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mine, theirs = set(b[head : len(b) - tail]), set(a[head : len(a) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in mine]
    other = [x for x in b[head : len(b) - tail] if x in theirs]
    where: dict[int, int] = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(other)) - 1

    def rows(first: int, last: int, v: int):
        """The rows behind a[at[first]] to a[at[last - 1]], after row v."""
        for i in range(first, last):
            u = v & where[a[at[i]]]
            v = (v + u | v - u) & full
            yield v

    step = max(1, int(len(at) ** 0.5))
    kept, v = [full], full
    for first in range(0, len(at) - step, step):
        for v in rows(first, first + step, v):  # noqa: B007
            pass
        kept.append(v)
    middle: list[int] = []
    col = len(other)
    for part in range(len(kept) - 1, -1, -1):
        first = part * step
        made = [kept[part], *rows(first, min(first + step, len(at)), kept[part])]
        row = len(made) - 1
        while row and col:
            if made[row] >> (col - 1) & 1:
                col -= 1
            else:
                if made[row - 1] >> (col - 1) & 1:  # the bit turned here, so this line is matched
                    middle.append(at[first + row - 1])
                    col -= 1
                row -= 1
    return [*range(head), *middle[::-1], *range(len(a) - tail, len(a))]


def _place(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


#: Two pages that share so much of their characters, in hundredths of the longer, are copies.
COPY = 90


def parsed(pages: DataFrame, url: str, html: str) -> DataFrame:
    """pages without html, and of each page: _host, _path, _lines, _kinds (what they are), and of each line its
    hash and length."""
    keep = [c for c in pages.columns if c != html]

    def run(batches):
        for batch in common.slices(batches):
            out: list[tuple] = []
            for place, page in zip(batch.column(url).to_pylist(), batch.column(html).to_pylist()):
                lines, kinds = blocks(page or "")
                out.append((*_place(place), lines, kinds, [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines], [len(x) for x in lines]))
            kinds_of = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(zip(*out), kinds_of))], names=[*keep, *(f.name for f in made)])

    made = T.StructType.fromDDL("_host string, _path string, _lines array<string>, _kinds array<tinyint>, _hashes array<bigint>, _sizes array<int>").fields
    return pages.mapInArrow(run, T.StructType([*pages.select(*keep).schema.fields, *made]))


def differences(found: DataFrame) -> DataFrame:
    """_row, shared (for each line whether the page's nearest one has it too); of found (_row, host, path,
    hashes, sizes), all rows with different _row. Pages that share nothing have no row.

    Pages of a host with equal lines count as one page, that of the smallest path. Pages that share
    nearly all their characters are copies too and do not delete each other's lines. Rows are sorted
    by ranges of (host, path, _row), so a host with a third of all pages is spread; the pages next to
    a range's ends come from a table with two rows for each partition.
    """
    key = ["host", "path", "_row"]
    found = found.withColumn("same", F.xxhash64("host", "hashes"))
    pages, found = found.select("_row", "same"), found.groupBy("same").agg(F.min_by(F.struct(*key, "hashes", "sizes"), F.struct(*key)).alias("r")).select("r.*", "same")
    parts = common.stash(found.repartitionByRange(*key).select("*", F.spark_partition_id().alias("part")), "pages-sorted")
    entry = F.struct("host", "path", "hashes", "sizes")
    order = Window.partitionBy("part").orderBy(*key)
    ends = parts.groupBy("part").agg(F.min_by(entry, F.struct(*key)).alias("head"), F.max_by(entry, F.struct(*key)).alias("tail"))
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("tail").over(by_part).alias("outer_before"), F.lead("head").over(by_part).alias("outer_after"))
    near = parts.withColumns({"before": F.lag(entry).over(order), "after": F.lead(entry).over(order)}).join(ends, "part")
    near = near.select("same", "host", "path", "hashes", "sizes", F.coalesce("before", "outer_before").alias("before"), F.coalesce("after", "outer_after").alias("after"))

    def run(batches):
        for batch in common.slices(batches):
            out = []
            for r in batch.to_pylist():
                best, length = None, -1
                for other in (r["before"], r["after"]):
                    if other and other["host"] == r["host"]:
                        n = next((i for i, (x, y) in enumerate(zip(r["path"], other["path"])) if x != y), min(len(r["path"]), len(other["path"])))
                        if n > length:
                            best, length = other, n
                if best:
                    at = shared_lines(r["hashes"], best["hashes"])
                    common_size = sum(r["sizes"][i] for i in at)
                    if at and 100 * common_size < COPY * max(sum(r["sizes"]), sum(best["sizes"])):
                        mask = [False] * len(r["hashes"])
                        for i in at:
                            mask[i] = True
                        out.append((r["same"], mask))
            cols = list(zip(*out)) or [[]] * 2
            kinds = [pa.int64(), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["same", "shared"])

    return pages.join(near.mapInArrow(run, "same long, shared array<boolean>"), "same").select("_row", "shared")


def extracted(pages: DataFrame, keep_html: bool = True) -> DataFrame:
    """pages (url, html and more columns) with `text string`: its lines joined by an empty line.

    Character references are decoded, white space in a block (br included) becomes one space. Null,
    empty and blank html, and pages without article text, give an empty text. Exact copies of a page
    on a host, and pages that share nearly all their characters with their neighbour, keep what they
    share; so do all lines of an article that markup names. Every row is a page of its own, also rows
    that repeat a page_id or have none. A null url counts as an empty host and path. A column named
    text is replaced, the others pass through (html only with keep_html); an empty table gives an
    empty table.
    """
    pages = common.without(pages, "text")
    names = {c.lower(): c for c in pages.columns}
    kept = [c for c in pages.columns if keep_html or c != names["html"]]
    column = lambda c: F.col(f"`{c}`")
    plain = pages.select(*[column(c).alias(f"_c{i}") for i, c in enumerate(kept)], column(names["url"]).alias("_url"), column(names["html"]).alias("_html")).withColumn("_row", F.monotonically_increasing_id())
    read = common.stash(parsed(plain, "_url", "_html").drop("_url"), "page-lines")
    lines = read.select("_row", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_hashes").alias("hashes"), F.col("_sizes").alias("sizes")).filter(F.size("hashes") > 0)
    both = read.drop("_host", "_path", "_hashes", "_sizes").join(common.stash(differences(lines), "page-shared"), "_row", "left")
    of = lambda i: F.get("_kinds", i)
    stays = F.filter("_lines", lambda _, i: (of(i) == SAFE) | (of(i) != OUTSIDE) & ~F.coalesce(F.get("shared", i), F.lit(False)))
    return both.select(*[F.col(f"_c{i}") for i in range(len(kept))], F.array_join(stays, "\n\n").alias("text")).toDF(*kept, "text")


def op2_html(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, keep_html=False).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
