from pyspark.sql import functions as F

from sedge.llm import common, html_text
from tests.conftest import SF

PAGES = "page_id long, url string, html string"


def text_of(html):
    return "\n\n".join(x for x, kind in zip(*html_text.blocks(html)) if kind != html_text.OUTSIDE)


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><header><h2>Title &amp; more</h2></header><p>First <b>bold</b>&nbsp;text<br>next line</p><p>Caf&eacute; &#233; &#x41;<!-- gone -->.
    <div class="ad">Buy</div><form><input name=q><button>Go</button></form><section id="comments"><p>A comment</p></section></article>
    <aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert text_of(page) == "Title & more\n\nFirst bold text next line\n\nCafé é A."


def test_main_and_role():
    assert text_of("<div>menu</div><main><p>a</p><p>b</main>") == "a\n\nb"
    assert text_of("<div>x</div><div role=main>body</div><div role=navigation>y</div>") == "body"


def test_broken_markup():
    assert text_of("<article><p>a <b>b<p>c</article>") == "a b\n\nc"
    assert text_of("<article>1 < 2 and <i>3") == "1 < 2 and 3"
    assert text_of("<script>never ends") == "" and text_of("<p") == "" and text_of("plain") == "plain"
    assert text_of("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a\n\nb\n\nc\n\nd"


def test_longest_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(5) for _ in range(r.randrange(12))], [r.randrange(5) for _ in range(r.randrange(12))]
        at = html_text.shared_lines(a, b)
        assert len(at) == slow(a, b) and at == sorted(set(at))
        seen = iter(b)
        assert all(a[i] in seen for i in at)


def bare(title, *lines):
    return "<body><p>Home | About</p><p>Share this page</p>" + "".join(f"<p>{x}</p>" for x in (title, *lines)) + "<p>All rights reserved</p></body>"


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [(1, "http://a.x/news/1", bare("One", "first")), (2, "http://a.x/news/2", bare("Two", "second")), (3, "http://b.x/", bare("Three", "third")), (4, "http://a.x/news/3", bare("One", "other"))]
    out = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1] == "One\n\nfirst" and out[2] == "Two\n\nsecond" and out[4] == "One\n\nother"
    assert out[3] == "Home | About\n\nShare this page\n\nThree\n\nthird\n\nAll rights reserved"


def test_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "::bad[", "<p>a</p>"), (None, "http://a/", "<article>n</article>"), (4, "http://h/1", "<article>same</article>"), (4, "http://h/1", "<article>same</article>"), (5, "http://h/2", "<article>" + "<p>long</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, PAGES).withColumns({"TEXT": F.lit("old"), "shared": F.lit(1)})
    out = html_text.extracted(df).collect()
    assert len(out) == 7
    by = {r.page_id: r.text for r in out}
    assert by[1] == by[2] == "" and by[None] == "n" and by[4] == "same" and by[5].count("long") == 20_000
    assert html_text.extracted(spark.createDataFrame([], PAGES)).collect() == []


def test_a_host_with_many_pages(spark):
    rows = [(i, f"http://one.x/p/{i:04d}", bare(f"Title {i}", f"body {i}")) for i in range(300)]
    out = html_text.extracted(spark.createDataFrame(rows, PAGES).repartition(9)).collect()
    assert all(r.text == f"Title {r.page_id}\n\nbody {r.page_id}" for r in out)


def test_whole_table(spark):
    out = html_text.op2_html(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == common.table(spark, SF, "pages").count() and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert not any("<" in r.text and "</" in r.text or "&copy" in r.text for r in rows)
