from __future__ import annotations

import re
import time
from html import unescape

import pytest

from millrace.llm import html

from .conftest import DATA

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="page has-sidebar"><article class="post-12"><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;line<br>goes on.
<p>Second   paragraph with &lt;tags&gt; and &eacute;.</p><div class="ad">Buy!</div><ul><li>item one<li>item two</ul>
<form><p>Sign up</p></form></article><aside><p>Side text that is long enough to count for something.</p></aside></div>
<section id="comments"><p>Nice article, thank you very much for it, I liked it.</p></section><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nFirst bold line goes on.\nSecond paragraph with <tags> and é.\nitem one\nitem two"


def test_page():
    found = html.blocks(PAGE)
    assert html.best_container(found).path == "html>body>div.has-sidebar.page>article.post-#"
    assert html.extract(PAGE, ["html>body>div.has-sidebar.page>article.post-#"]) == TEXT
    assert html.extract(PAGE, []) == TEXT
    assert html.extract(PAGE, ["html>body>main"]) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>cut off <b", "cut off"),
        ("</div></p><p>a</span>b", "ab"),
        ("<nav>only a menu</nav>", ""),
        ("<p>a<!-- <p>no</p> -->b &am &amp c", "ab &am & c"),
        ("<table><tr><td>x<td>y</table>", "x\ny"),
        ("<script>never ends <p>x", ""),
        ("<div><P CLASS=x>up</P><p title='a>b'>quoted", "up\nquoted"),
    ],
)
def test_small_pages(page, text):
    assert html.extract(page, []) == text


LEDE = "A lede that says in a sentence what follows. "
BODY = "A sentence of the body, which is long enough to be read as prose. " * 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article class='article side'><p>{BODY}</p></article>", BODY),
        (f"<article><p>{BODY}</p><section id='related-work'><h2>Related work</h2><p>{LEDE}</p></section></article>", f"{BODY}\nRelated work\n{LEDE}"),
        (f"<body><header><p>Site name and a slogan.</p></header><article><header><h1>Headline</h1></header><p>{BODY}</p></article></body>", f"Headline\n{BODY}"),
        (f"<article><p>So <math><mi>x</mi>=1</math> and press <button>Go</button> now.</p><p>{BODY}</p><button>Subscribe</button></article>", f"So x=1 and press Go now.\n{BODY}"),
        (f"<article><h1>Head</h1><p>{LEDE}</p><div class='body'><p>{BODY}</p></div><div class='more'><p>{LEDE}</p></div></article>", f"Head\n{LEDE}\n{BODY}\n{LEDE}"),
        (f"<body><div class='post'><h1>Head</h1><p>{LEDE}</p><div class='body'><p>{BODY}</p></div></div><div><a href='/'>Home page of it</a></div></body>", f"Head\n{LEDE}\n{BODY}"),
        (f"<body><div id='x'><p>{LEDE}</p><ol><li>{BODY}</li><li>{BODY}</li></ol></div></body>", f"{LEDE}\n{BODY}\n{BODY}"),
        (f"<main><p>{BODY}</p><div class='related-posts'><p>{LEDE}</p></div><div id='comments'><p>{LEDE}</p></div><div class='share'>{LEDE}</div></main>", BODY),
        (f"<p title=it's>{BODY}</p><p>don't</p>", f"{BODY}\ndon't"),
    ],
)
def test_nothing_of_an_article_is_lost(page, text):
    assert html.extract(page, []) == "\n".join(x.strip() for x in text.split("\n"))


@pytest.mark.parametrize(
    "unit",
    ["<a ", "<a b='", '<a b="', "<", "<div>", "<head>", "</head", "<div></p>", "<!--", "<p>&", "</div>", "<ul><li>", "<table><tr><td>", "<a b=", "<svg/>", "<style>", "<div class='a b>c'>x"],
)
def test_hostile_pages_take_linear_time(unit):
    page = unit * (1_000_000 // len(unit)) + '"'
    began = time.process_time()
    html.extract(page, ["html>body>div"])
    assert time.process_time() - began < 4


def test_labelled_pages(spark):
    """Against the articles of the generated pages, which are marked as such; words found and words wanted."""
    pages = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html.main_text(pages).collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in re.split(r"</?(?:h1|p|ul|li)\b[^>]*>", inside)]
        assert r.text == "\n".join(x for x in blocks if x)


def test_ties_of_paths():
    """Of winning paths that hold the same text the deeper one gives it; where none holds most of a page, the page's own."""
    page = f"<div class='a'><div class='b'><p>{BODY}</p></div></div><div class='c'><p>One more.</p></div>"
    assert html.extract(page, ["div.a", "div.a>div.b"]) == html.extract(page, ["div.a>div.b", "div.a"]) == BODY.strip()
    page = f"<body><div class='a'><p>{BODY}</p></div><div class='c'><p>{BODY}</p></div></body>"
    assert html.extract(page, ["body>div.c", "body>div.a"]) == f"{BODY.strip()}\n{BODY.strip()}"


def test_hosts_agree(spark):
    body = "<html><body><div class='c{0}'><p>{1}</p></div><div class='tail'><p>{2}</p></div></body></html>"
    long, short = "A long sentence that is the article of this page, as it should be. " * 3, "Short one."
    rows = [(i, f"http://WWW.x.org:80/{i}", body.format(i, long, short)) for i in range(20)]
    rows += [(100, "http://www.x.org/odd", body.format(1, "A sentence here.", "Another tail of this page is longer.")), (101, None, None), (101, None, None), (None, "bad url", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS paths", "'z' AS text")
    won = {r.host: r.paths for r in html.winning_paths(pages).collect()}
    assert won["www.x.org"][0] == "html>body>div.c#"
    got = {}
    for r in html.main_text(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == [long.strip()] for i in range(20)) and got[101] == ["", ""] and got[None] == ["x"]
    assert html.main_text(pages.where("false")).count() == 0


def test_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    rows = html.main_text(pages).collect()
    assert len(rows) == pages.count() and all(r.text and "<" not in r.text for r in rows)
    one = next(r for r in rows if r.page_id == 3)
    source = pages.where("page_id = 3").first().html
    assert one.text.split("\n")[0] == source.split("<h1>")[1].split("</h1>")[0]
