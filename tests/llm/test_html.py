import random

import pytest

from flowkit.llm import html

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head>
<body><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies</div><div id="sidebar">side</div><form><p>Name <input name="q"></p></form>
<article><header><h1>The &lt;title&gt; &amp; more</h1></header><p>First <b>bold</b>
  text&nbsp;here.<br>next<p>Second &#x41;&#66;.<ul><li>one<li>two</ul><div class="ad">Buy</div><table><tr><td>c1<td>c2</table>
<section class="comments"><p>Nice!</p></section></article><aside>aside</aside><footer>&copy; x</footer></body></html>"""


def text(page, low=()):
    return html._article(page, frozenset(low))


def test_article():
    assert text(PAGE) == "The <title> & more\nFirst bold text here. next\nSecond AB.\none\ntwo\nc1\nc2"


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("plain   text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<p><b>a<br><p>b</p>", "a\nb"),
        ("a < b <p>1 <2", "a < b\n1 <2"),
        ("<article>x</article><p>teaser</p>", "x"),
        ("<main><p>m</p></main><p>other</p>", "m"),
        ("<div role='navigation'>n</div><p>t</p>", "t"),
        ("<p>a</p></div></p><p>b", "a\nb"),
        ("<script>never closed <p>x", ""),
        ("<article><p>cut off <b>he", "cut off he"),
        ("<p title='a>b'>q</p>", "q"),
        ("<P CLASS=Advert>x</P><P>y</P>", "y"),
        ("<!-- open <p>x</p>", ""),
        ("<p>&notit; &amp;amp; &#0; &#128512;</p>", "¬it; &amp; \ufffd 😀"),
        ("<main><h1>T</h1><p>Main text one.</p><article class='teaser'>more</article></main><p>out</p>", "T\nMain text one.\nmore"),
        ("<div class='side-effects'>Real text</div><div class='cookie-notice'>c</div><div id='site_footer'>f</div>", "Real text"),
        ("<div hidden>x</div><p>y</p><p hidden=hidden>z</p><p title='hidden'>w</p>", "y\nw"),
        ("<p>Let <math><mi>x</mi></math> be", "Let x be"),
    ],
)
def test_odd_pages(page, expected):
    assert text(page) == expected


def test_bad_input_takes_linear_time():
    import time

    began = time.monotonic()
    for page in ("<" * 200_000, "<a " * 60_000, "<p " + "x='" * 50_000, "<!--" * 50_000, "<p>" * 20_000, "&" * 200_000, "<div>word" * 20_000, "<ul><li>" * 20_000, "<b><div></p></b>" * 20_000):
        text(page)
    assert time.monotonic() - began < 30


def site(n, seed=1):
    """Pages without any telling names: a repeated box, and text of their own."""
    r = random.Random(seed)
    words = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(12))
    pages = []
    for i in range(n):
        paragraphs = [words() for _ in range(r.randrange(2, 6))]
        box = "<div class='k9'><p>Read this every day</p><p>Best site of the year</p></div>"
        pages.append((i, f"http://h.example.com/{i}", f"<html><body>{box}<div class='k1'>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div></body></html>", "\n".join(paragraphs)))
    return pages


def test_style_tree_finds_unnamed_boilerplate(spark):
    pages = site(30)
    lone = (100, "http://other.example.com/", "<div class='k9'><p>Read this every day</p></div>", "Read this every day")
    df = spark.createDataFrame([(*p[:3], 1, "x") for p in [*pages, lone, (101, None, None, ""), (102, "x", "", "")]], "page_id long, url string, html string, node int, host string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {p[0]: (p[3], len(p[3])) for p in [*pages, lone, (101, None, None, ""), (102, "x", "", "")]}


def unnamed(n, article, seed=2):
    """Pages with a box, a menu and a footer without telling names, whose words change from page to page."""
    r, pages = random.Random(seed), []
    text = lambda k, pool: " ".join(f"w{r.randrange(pool)}" for _ in range(k))
    for i in range(n):
        body = [text(12, 9999) for _ in range(r.randrange(2, 7))]
        menu = "".join(f"<li><a href='/{text(1, 40)}'>{text(1, 40)}</a></li>" for _ in range(5))
        end = f"<div class='k2'><p>Page {i} seen {r.randrange(99)} times by our readers of this place since the start of the year</p></div>"
        main = "".join(f"<p>{x}</p>" for x in body)
        main = f"<article>{main}</article>" if article else f"<div class='k1'>{main}</div>"
        pages.append((i, f"http://h.example.com/{i}", f"<html><body><div class='k9'><ul>{menu}</ul></div>{main}{end}</body></html>", "\n".join(body)))
    return pages


@pytest.mark.parametrize("article", [False, True])
def test_style_tree_finds_boilerplate_whose_words_change(spark, article):
    """By the tree alone: no name is heeded."""
    pages = unnamed(40, article)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df, declared=False).collect()} == {p[0]: p[3] for p in pages}


def test_given_pages_by_the_tree_alone(spark):
    """Without names, roles and classes the tree takes the menus from the given pages, and nothing from their articles.

    Adverts and footers there are single sentences that differ on every page: only what the elements are called tells them.
    """
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    shipped = {r.page_id: r.text for r in html.extract(pages).collect()}
    alone = {r.page_id: r.text for r in html.extract(pages, declared=False).collect()}
    same = 0
    for r in pages.select("page_id", "html").collect():
        parts = [html._article(x, frozenset()) for x in re.findall('<div class="ad">(.*?)</div>', r.html, re.S)]
        parts += [shipped[r.page_id], *(html._article(x, frozenset()) for x in re.findall("<footer>(.*?)</footer>", r.html, re.S))]
        same += alone[r.page_id] == "\n".join(x for x in parts if x)
    assert same > 0.95 * len(shipped), same / len(shipped)


def test_importances(spark):
    df = spark.createDataFrame([("h", p[2]) for p in site(16)], "host string, html string")
    found = {r.node: r for r in html.importances(html.weights(df).selectExpr("1L as host", "cast(weight as double) weight", "html")).collect()}
    node = 0
    for label in ("html", "body", "div.k9"):
        node = html.crc32(f"{node}>{label}".encode())
    assert found[node].pages == 16 and found[node].importance < 0.1
    parent = html.crc32(f"{html.crc32(b'0>html')}>body".encode())
    assert found[html.crc32(f"{parent}>div.k1".encode())].importance > 0.5


def test_copies_of_an_article_stay(spark):
    df = spark.createDataFrame([(i, "http://h/x", "<body><article><h1>Same</h1><p>text</p></article></body>") for i in range(20)] + [(7, "http://h/x", "<p>again</p>")], "page_id long, url string, html string")
    assert sorted(r.text for r in html.extract(df).collect()) == ["Same\ntext"] * 20 + ["again"]
    assert html.extract(df.limit(0)).count() == 0
