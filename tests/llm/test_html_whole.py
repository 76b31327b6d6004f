"""Whole pages: wrappers, copies, hard markup, and the whole table against an independent slow version."""

import random
import re
import time
from html import unescape
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest
from sedge.llm import html_text
from tests.conftest import SF
from tests.llm.test_html import PAGES, bare, text_of

def test_words_of_class_do_not_drop_the_article():
    assert text_of('<nav>menu</nav><article class="post has-sidebar"><p>a</p></article>') == "a"
    assert text_of('<div class="layout with-sidebar"><article><p>a</p><div class="share">x</div></article><div class="sidebar">y</div></div>') == "a"
    assert text_of('<div class="layout with-sidebar"><div id="promo-page"><main class="no-sidebar"><p>a</p></main></div></div>') == "a"
    assert text_of('<main><h1>T</h1><div class="layout with-sidebar"><article>a</article></div><div id="comments"><article>c</article></div></main>') == "T\n\na"


def test_other_articles_still_go():
    assert text_of('<article>a</article><div class="related"><article>card</article></div>') == "a"
    assert text_of('<main><p>a</p><div id="comments"><article class="comment">c</article></div></main><div class="related"><article>card</article></div>') == "a"
    assert text_of('<div class="with-sidebar"><article>a</article><div class="related"><article>card</article></div></div>') == "a"
    assert text_of('<article>a<section class="comments"><article>c</article></section></article>') == "a"


def test_exact_copies_keep_their_text(spark):
    rows = [(1, "http://a.x/n?id=1", bare("One", "first")), (2, "http://a.x/n?id=2", bare("One", "first")), (3, "http://a.x/o", bare("Two", "second")), (4, "http://b.x/1", bare("Only", "copy")), (5, "http://b.x/2", bare("Only", "copy"))]
    out = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1] == out[2] == "One\n\nfirst" and out[3] == "Two\n\nsecond"
    assert out[4] == out[5] and "Only\n\ncopy" in out[4]


def test_words_beside_others_need_a_neighbour(spark):
    page = '<article><p>{}</p><div class="related-work"><p>Work of others</p><p>{}</p></div><p>Shared passage</p></article>'
    rows = [(1, "http://a.x/1", page.format("one", "own one")), (2, "http://a.x/2", page.format("two", "own two")), (3, "http://b.x/3", page.format("three", "own three"))]
    out = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1] == "one\n\nown one\n\nShared passage" and out[2] == "two\n\nown two\n\nShared passage"
    assert out[3] == "three\n\nWork of others\n\nown three\n\nShared passage"


def test_forms_quotes_and_nesting():
    assert text_of("<form id=f><div><article><p>a</p><form><p>b</p></form></article></div></form><form><p>Search</p></form>") == "a"
    assert text_of('<article><a href="x>link</a> text</article>') == "link text"
    assert text_of("<article><a title='x>link</a> text</article>") == "link text"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article>" + '<p title="x>a' * 20_001 + "</article>", None),
        ("<article>" + "<div>" * 30_000 + "deep" + "</div>" * 30_000 + "</article>", "deep"),
        ("<article>" + "<b>" * 30_000 + "<p>a</p>" * 5_000 + "</article>", "\n\n".join(["a"] * 5_000)),
        ("<" * 100_000, "<" * 100_000),
        ("<p " + "x" * 300_000, ""),
        ("<!--" * 50_000, ""),
    ],
)
def test_hard_markup_takes_no_longer_than_its_length(html, text):
    start = time.perf_counter()
    got = text_of(html)
    assert text is None or got == text
    assert time.perf_counter() - start < 3


def test_subsequences_of_many_equal_lines():
    r = random.Random(2)
    start = time.perf_counter()
    assert html_text.shared_lines([1] * 50_000, [1] * 40_000) == [*range(40_000)]
    a, b = [r.randrange(3) for _ in range(6_000)], [r.randrange(3) for _ in range(5_000)]
    assert len(html_text.shared_lines(a, b)) > 3_500
    assert time.perf_counter() - start < 5


def test_near_copies_keep_what_they_share(spark):
    body = [f"a long line number {i} that all of the copies have in common" for i in range(20)]
    rows = [(1, "http://a.x/1", bare("Title", *body, "one edit")), (2, "http://a.x/2", bare("Title", *body, "other edit")), (None, "http://c.x/1", bare("One", "null ids")), (None, "http://c.x/2", bare("Two", "are pages too"))]
    out = [(r.page_id, r.text) for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()]
    assert all("\n\n".join(body) in t for i, t in out if i)
    assert sorted(t for i, t in out if i is None) == ["One\n\nnull ids", "Two\n\nare pages too"]


def slow_lines(html):
    """Lines of the test tables' pages, which have few tags, by regular expressions alone."""
    html = re.sub(r"<!--.*?-->|<(script|style|head)[^>]*>.*?</\1>|<(nav|footer)>.*?</\2>|<div class=\"ad\">.*?</div>", "", html, flags=re.S)
    html = re.sub(r"<(?:br)>", " ", re.sub(r"</?b>", "", html))
    return [t for t in (" ".join(unescape(p).split()) for p in re.split(r"<[^>]*>", html)) if t]


def slow_subsequence(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def pages():
    return [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]


def test_whole_table_against_a_slow_version(spark):
    found = {r.page_id: r.text for r in html_text.op2_html(spark, SF).collect()}
    want = {i: "\n\n".join(slow_lines(re.search("<article>.*</article>", html, re.S)[0])) for i, _, html in pages()}
    assert found == want


def test_whole_table_without_article_tags_is_differenced(spark):
    rows = [(i, url, re.sub("<(/?)article>", r"<\1div>", html)) for i, url, html in pages()]
    found = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    by = {}
    for i, url, html in rows:
        u = urlsplit(url)
        by.setdefault((u.hostname.removeprefix("www."), tuple(slow_lines(html))), []).append((u.path, i))
    first = sorted((host, min(ids), lines, [i for _, i in ids]) for (host, lines), ids in by.items())
    deleted = 0
    for n, (host, (path, _), lines, ids) in enumerate(first):
        near, length = None, -1
        for other in (first[n - 1] if n else None, first[n + 1] if n + 1 < len(first) else None):
            if other and other[0] == host:
                k = next((k for k, (x, y) in enumerate(zip(path, other[1][0])) if x != y), min(len(path), len(other[1][0])))
                if k > length:
                    near, length = other[2], k
        shared = slow_subsequence(lines, near) if near else 0
        size, whole = (sum(map(len, x)) for x in (lines, near or ()))
        for i in ids:
            got = found[i].split("\n\n") if found[i] else []
            if len(got) == len(lines) and shared:  # copies keep all
                assert got == list(lines) and sum(len(x) for x in set(lines) & set(near)) >= 0.9 * max(size, whole) * 0.9
            else:
                assert len(got) == len(lines) - shared
                at = iter(lines)
                assert all(x in at for x in got)
                deleted += shared
    assert deleted > 0
