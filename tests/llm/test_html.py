import re
from html import unescape

import numpy as np
import pytest

from tidelog.llm import html
from tidelog.llm.common import table

PAGES = "page_id long, url string, html string"


def plain_article(page):
    """The text of `article` on pages of the tables' simple kind."""
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
    return " ".join(filter(None, (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", part))).strip() for part in re.split(r"<(?:p|h1|/p|/h1|br)>", body))))


def test_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    given = {row.page_id: row for row in pages.collect()}
    rows = html.op8(pages).collect()
    assert {row.page_id for row in rows} == set(given) and len(rows) == len(given)
    for row in rows:
        assert row.text == plain_article(given[row.page_id].html)
        assert row.url == given[row.page_id].url
        assert row.n_chars == len(row.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>a</nav><article><h1>T &amp; U</h1><p>one<br>two &lt;3 &#233;<p>three <b>bold</article><footer>f</footer>", "T & U one two <3 é three bold"),
        ("<main><p>x</p><div class='sidebar'>y</div><form>z</form></main>", "x"),
        ("<main>m<article>a<aside>b</aside></article></main><article class='comment'>c</article>", "a"),
        ("<article>a<script>var t='</article>';</script><style>p{}</style><!-- c --><div class=\"ad\">d</div>b</article>", "a b"),
        ("<article><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>4<td>5</table></article>", "1 2 3 4 5"),
        ("<article>a &amp b &am", "a & b &am"),
        ("<article>R&amp;<i>amp;</i>D a<b>b</b>c", "R&amp;D abc"),
        ("<article>1 < 2 > 0</article>", "1 < 2 > 0"),
        ("<article><p title=\"a>b\">x</p><p hidden>y</p><p style='display: none'>z</p><div role=navigation>w</div></article>", "x"),
        ("<p>only</p>", "only"),
        ("<p", ""),
        ("", ""),
        ("\x00<article>\n a \t  b \n</article>", "a b"),
    ],
)
def test_pages(page, text):
    lines, marks = html.lines_of(page)
    best = max(marks, default=0)
    assert " ".join(line for line, mark in zip(lines, marks, strict=True) if mark == best) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>a</p><figure><img><figcaption>caption</figcaption></figure><p>b</p></article>", "a caption b"),
        ("<article><p>with f(<math><mi>x</mi></math>) in it</p><math display='block'><mi>y</mi><mo>=</mo><mn>2</mn></math>c</article>", "with f(x) in it y=2 c"),
        ("<article>a<svg><text>s</text></svg>b<object>o</object><video>v</video><canvas>w</canvas></article>", "a s b o v w"),
        ("<main><h1>Title</h1><p>the text</p><article>card</article></main>", "Title the text card"),
        ("<main><p>m</p><article>a</article></main><article>b</article>", "a b"),
        ("<article>a<main>m</main></article>", "a m"),
        ("<main><article>a</article></main>", "a"),
    ],
)
def test_what_belongs_to_an_article(page, text):
    assert " ".join(html.open_lines(page)[0]) == text


def test_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(0, 14)), rng.integers(0, 5, rng.integers(0, 14))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        found = html.shared_lines(a, b)
        assert len(found) == best[-1, -1] == len(set(found.tolist()))
        left = iter(b.tolist())
        assert all(line in left for line in a[found].tolist())


def page(own, template=("Home | About", "All rights reserved")):
    return f"<div>{template[0]}</div>" + "".join(f"<p>{line}</p>" for line in own) + f"<div>{template[1]}</div>"


def test_differencing(spark):
    story = ["a long and quite singular line of the story number {}", "which goes on with more words in chapter {}", "until it ends {}"]
    rows = [(i, f"http://a.com/x/{i:02d}", page([s.format(i) for s in story])) for i in range(9)]
    rows += [(20, "http://b.com/x/1", page(["only page of its host"])), (21, "http://c.com/1", page([s.format("z") for s in story])), (22, "http://c.com/2", page([s.format("z") for s in story]))]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as lines", "3 as gone", "4 as page_key")
    found = {row.page_id: row.text for row in html.op8(frame.repartition(5)).collect()}
    for i in range(9):
        assert found[i] == " ".join(s.format(i) for s in story)
    assert found[20] == "Home | About only page of its host All rights reserved"
    assert found[21] == found[22] == "Home | About " + " ".join(s.format("z") for s in story) + " All rights reserved"


@pytest.mark.parametrize("parts", [1, 7])
def test_templates_that_outweigh_articles_and_copies(spark, parts):
    menu, legal = "Home | About | Products | Contact | Jobs | Press | Site map", "All rights reserved by whom it may concern, wherever they are"
    rows = [(i, f"http://a.com/{i:02d}", page([f"short {i}"], (menu, legal))) for i in range(9)]
    # Copies under neighbouring paths, then copies of another page.
    rows += [(20 + i, f"http://b.com/{i}", page([f"story {i // 4}"], (menu, legal))) for i in range(8)]
    # Pages that differ in a line only, beside one of another article: the article stays.
    body = "an article that is long enough to outweigh the menu and the legal line of its site by far, and goes on and on and on, more than twice as long as both"
    rows += [(40 + i, f"http://c.com/{i}", page([f"seen {i} times", body], (menu, legal))) for i in range(6)]
    rows += [(50, "http://c.com/9", page([body[::-1]], (menu, legal)))]
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, str(parts == 1).lower())  # runs of pages lie in one range, or across several
    try:
        found = {row.page_id: row.text for row in html.op8(spark.createDataFrame(rows, PAGES).repartition(parts)).collect()}
    finally:
        spark.conf.unset(coalesced)
    assert {i: found[i] for i in range(9)} == {i: f"short {i}" for i in range(9)}
    assert {i: found[20 + i] for i in range(8)} == {i: f"story {i // 4}" for i in range(8)}
    assert {i: found[40 + i] for i in range(6)} == {i: f"seen {i} times {body}" for i in range(6)}
    assert found[50] == body[::-1]


def test_differencing_inside_marked_articles(spark):
    rows = [(i, f"http://a.com/{i}", f"<nav>n</nav><article><h1>T{i}</h1><p>a long and singular line of story {i}</p><p>Share this</p></article>") for i in range(5)]
    rows += [(5, "http://a.com/5", "<main><p>a story in another element, long enough</p><p>Share this</p></main>")]
    # A headline and a quotation of few pages are the article's.
    rows += [(10 + i, f"http://b.com/{i}", f"<article><h1>News {i // 2}</h1><p>story {i} of the site and what more there is of it</p></article>") for i in range(8)]
    found = {row.page_id: row.text for row in html.op8(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: found[i] for i in range(6)} == {i: f"T{i} a long and singular line of story {i}" for i in range(5)} | {5: "a story in another element, long enough"}
    assert {i: found[10 + i] for i in range(8)} == {i: f"News {i // 2} story {i} of the site and what more there is of it" for i in range(8)}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, None, ""), (None, "http://a.com/", "<p>a</p>"), (3, "http://a.com/", "<p>a</p>"), (3, "http://a.com/", "<p>a</p>"), (2**60 + 1, "u", "<article>" + "w " * 100_000)]
    found = sorted((str(row.page_id), row.n_chars) for row in html.op8(spark.createDataFrame(rows, PAGES)).collect())
    assert found == sorted([("1", 0), ("2", 0), ("None", 1), ("3", 1), ("3", 1), (str(2**60 + 1), 199_999)])
    assert html.op8(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content-sidebar-wrap"><main><article>a</article></main><div class="sidebar">s</div></div>', "a"),
        ('<div class="layout no-sidebar"><article>a</article></div>', "a"),
        ('<div id="reply"><main>a</main></div>', "a"),
        ('<div class="has-comments page"><article>a<p>b</p></article></div>', "a b"),
        ('<form id="aspnetForm"><div class="nav">n</div><article>a</article></form>', "a"),
        ("<article><header><h1>Headline</h1><p>by me</p></header><p>a</p></article>", "Headline a"),
        ("<main><header class='nav'><h2>Site</h2></header><p>a</p></main>", "a"),
        ("<header><h1>Site</h1></header><article>a</article>", "a"),
        # What encloses no article of the page hides what it holds, cards and remarks among it.
        ('<article>a</article><section class="related-posts"><article>card</article></section>', "a"),
        ('<article>a</article><div class="comments"><article>remark</article></div>', "a"),
        ('<article>a<form class="subscribe"><p>f</p></form><div class="sidebar-content">s</div></article>', "a"),
        ("<aside><article>card</article></aside><article>a</article>", "a"),
        ('<div hidden><article>h</article></div><article>a</article>', "a"),
    ],
)
def test_wrappers_of_articles(page, text):
    assert " ".join(html.open_lines(page)[0]) == text
