"""Blocks of a page, differencing against a plain walk over all pages, and the article of every given page."""

import html
import random
import re

import pytest

from redline.llm import page_difference
from redline.llm.page_lines import scan

SF = "/root/testdata/sf0.001"


def plain(page):
    return [t for t, muted, _ in scan(page) if not muted]


def kept(page):
    return page_difference.read_lines(page)[0]


def test_blocks_and_references():
    assert plain("<p>a <i>b</i>c<p>d &amp;amp; e<br>f\n\t g<div>h</div>i") == ["a bc", "d &amp; e f g", "h", "i"]
    assert plain("1 < 2 &lt; 3 <!-- <p>x --> y") == ["1 < 2 < 3 y"]
    assert plain("<script>var t='</p>';</script>x<style>p{}</style><title>t</title>y") == ["x", "y"]
    assert plain("<p title='a>b'>x<p title=it's>y<br/>z") == ["x", "y z"]
    assert plain("<ul><li>a<li>b<ul><li>c</ul>d</ul><td>e<td>f") == ["a", "b", "c", "d", "e", "f"]
    assert plain("a<!-- open <p>b") == ["a"] and plain("a<script>b") == ["a"] and plain("a<b") == ["a"]
    assert plain("") == plain("<p> \n </p>") == [] and scan("x" * 100_000)[0][0] == "x" * 100_000
    assert plain("<div>" * 5000 + "deep" + "</div>" * 5000 + "</div>end") == ["deep", "end"]


def test_named_parts_go():
    page = """<body class="has-sidebar"><header>h</header><nav><ul><li>n</ul></nav><div class="cookieNotice">c</div>
      <div id=main-menu>m</div><p>text one</p><div class="content with-sidebar"><p>text two</p></div>
      <form>f<p>g</form><section class="comments-area"><article class=comment>r</article></section>
      <p hidden>x</p><div role="complementary">s</div><p>in <span class="ad">buy <b>now</b></span> line</p>
      <ul><li><a href=/a>link</a><li><a href=/b>other link</a></ul><footer>&copy; z</footer>"""
    assert plain(page) == ["text one", "text two", "in", "line"]


def test_article_of_a_page():
    page = """<p>teaser</p><article><header><h1>Title</h1><p>by line</header><p>One.<aside>side</aside>Two<ul><li><a>3</a></ul>
      <div class="share">tell</div></article><p>after</p>"""
    assert kept(page) == ["Title", "One.", "Two", "3"]
    assert kept("<main><p>all of it</main>rest") == ["all of it"]
    small = "<article>card</article><p>the text of this page stands in no article</p>"
    assert kept(small) == ["card", "the text of this page stands in no article"]


def lcs_marks(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    marks = [False] * len(a)
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            marks[i] = True
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return marks


def plain_differences(pages):
    """{page id: lines} of pages whose lines have no markup but <p>, by a walk over the ordered pages."""
    def parts(url):
        m = re.match(r"[^:]*://([^/?#]*)([^?#]*)", url)
        return m[1].lower(), m[2]
    order = sorted((*parts(u), i, ls) for i, u, ls in pages)
    out = {}
    for at, (host, path, i, lines) in enumerate(order):
        def same(p):
            return next((k for k, (x, y) in enumerate(zip(path, p)) if x != y), min(len(path), len(p)))
        near = sorted((-same(order[j][1]), abs(at - j), j) for j in range(max(0, at - 2), min(len(order), at + 3))
                      if j != at and order[j][0] == host)
        marks = [False] * len(lines)
        for _, _, j in near:
            mine, theirs = lcs_marks(lines, order[j][3]), lcs_marks(order[j][3], lines)
            share = [sum(len(x) for x, m in zip(ls, ms) if m) / max(1, sum(map(len, ls)))
                     for ls, ms in ((lines, mine), (order[j][3], theirs))]
            if max(share) <= 0.5:
                marks = mine
                break
        out[i] = [x for x, m in zip(lines, marks) if not m]
    return out


def test_differences_of_a_hot_host_in_blocks(spark):
    """Templates without names; articles, and copies of one; one host with most pages; a page alone on its host."""
    rng = random.Random(9)
    pages = []
    for i in range(300):
        host = rng.choice(["Big.example.com"] * 4 + ["b.example.org", "c.example.net"]) if i else "alone.example"
        body = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(rng.randrange(1, 5))]
        if i % 10 == 3:
            body = [f"copied paragraph number {k} with enough words to count as text" for k in range(9)]
        top = [f"{host} top", "all news of today"] + (["weather"] if rng.random() < 0.5 else [])
        pages.append((i, f"https://{host}/{rng.choice('ab')}/{rng.randrange(400)}?q={i}", top + body + [f"imprint {host}"]))
    rows = [(i, u, "<html><body>" + "".join(f"<p>{x}</p>" for x in ls)) for i, u, ls in pages]
    got = page_difference.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    got = {r._id: r.lines for r in got.collect()}
    assert got == plain_differences(pages)
    texts = [x for i, ls in got.items() if i and i % 10 != 3 for x in ls]
    assert sum(x.startswith("w") and x != "weather" for x in texts) == sum(
        x.startswith("w") and x != "weather" for i, _, ls in pages if i and i % 10 != 3 for x in ls)
    assert sum("imprint" in x for x in texts) < 30 < sum(i % 10 != 3 for i in range(300))


def test_the_difference_decides_what_the_article_is(spark):
    """An element named article that every page of a site has is none; one that holds what a page alone says is, be it small."""
    def words(seed, n):
        return " ".join(f"w{random.Random(f'{seed} {k}').randrange(10**6)}" for k in range(n))

    card = f"<article><p>{words('card', 40)}"
    rows, want = [], {}
    for i in range(4):
        rows.append((i, f"http://cards.example/{i}", f"{card}<p>{words(f'by {i}', 8)}</article><p>{words(f'text {i}', 38)}"))
        want[i] = [words(f"by {i}", 8), words(f"text {i}", 38)]
        rows.append((10 + i, f"http://template.example/{i}", f"<p>{words('all sites', 45)}<article><p>{words(f'a {i}', 30)}"
                     f"<p>{words('licence', 3)}<p>{words(f'b {i}', 10)}</article><p>{words(f'c {i}', 12)}"))
        want[10 + i] = [words(f"a {i}", 30), words("licence", 3), words(f"b {i}", 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r._id: r.lines for r in page_difference.main_text(pages).collect()} == want


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, _row int, position string, lines string, _lines int"
    rows = [(1, "http://a/x", "<p>one", 1, None, None, None), (1, "http://a/x", "<p>one", 1, None, None, None),
            (2, None, "<p>two", 2, None, None, None), (3, "http://a/y", None, 3, None, None, None),
            (None, "no host", "", 4, None, None, None), (4, "http://b/", "<article><p>" + "long " * 50_000, 5, "", "", 0),
            (5, "HTTP://A/z", "<p>one<p>three four five", 6, None, None, None),
            (6, "http://A/zz", "<p>one<p>seven eight nine", 6, None, None, None)]
    got = sorted((r._id if r._id is not None else -1, r._url, r.lines) for r in page_difference.main_text(
        spark.createDataFrame(rows, schema)).collect())
    assert [(i, ls) for i, _, ls in got] == [(-1, []), (1, ["one"]), (1, ["one"]), (2, ["two"]), (3, []),
                                             (4, [("long " * 50_000).strip()]), (5, ["three four five"]),
                                             (6, ["seven eight nine"])]
    assert page_difference.main_text(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_every_given_page_keeps_its_whole_article(spark, sf):
    got = {r.page_id: r for r in page_difference.op12_page_difference(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*)</article>", p.html, re.S)[1])
        lines = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in blocks]
        assert got[p.page_id].text == "\n".join(x for x in lines if x)
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url
