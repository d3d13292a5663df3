import re
import time
from html import unescape

from varve.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page">
<header><a href=/>Home</a><p>Site name</p></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div id="cookie-notice">We use cookies on this site, please accept all of them right now.</div>
<div class="wrap"><div class="content"><h1>Head &amp; line</h1><p>First paragraph   of the
story, long enough to count.<p>Second, with <a href=x>a link</a>, <b>bold</b> and <i>more</i> text.
<form><label>Mail</label><input></form><div class="ad">Buy this thing now</div><script>var a = "<p>no</p>";</script>
<ul><li>one item<li>two items</ul><!-- gone --></div>
<div class="sidebar"><p>Related things that are long enough to look like an article here.</p></div></div>
<section id="comments"><p>A reader says this at some length, as readers often do, on and on.</p></section>
<footer>&copy; 2020</footer></body></html>"""


def test_article_alone_is_left():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph of the story, long enough to count.\nSecond, with a link, bold and more text.\none item\ntwo items"


def test_edges_of_input(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "plain &lt;text&gt;", 1), (3, "u", "plain &lt;text&gt;", 1), (4, "u", "<p>" * 3000 + "deep", 1), (5, "u", "<div" * 50 + "<", 1)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got[1] == got[2] == ("", 0) and got[3] == ("plain <text>", 12) and got[4] == ("deep", 4)
    assert html_text.extract(pages).count() == 6 and html_text.extract(pages.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 20000 + "x" + "</div>" * 20000) == "x"


def test_query_against_plain_reading(spark, sf_small):
    for r in spark.read.parquet(f"{sf_small}/pages.parquet").join(html_text.op8_html_text(spark, sf_small).select("page_id", "text", "n_chars"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_names_that_an_article_may_use_itself():
    body = "<p>First paragraph of a story that goes on for quite some time, as stories do.</p>" * 3
    for part in ('<section id="discussion"><p>What follows from it, at some length.</p></section>', '<p class="share-price">The share price rose to twelve.</p>', '<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>', "<object>Drawn by hand.</object>", '<div class="popular related">Often read, and by many.</div>', '<p id="side">A side of a cube.</p>'):
        got = html_text.main_text(f"<body><nav>menu</nav><article><h1>Head</h1>{body}{part}</article><footer>foot</footer></body>")
        assert got.count("\n") >= 3 and got.endswith(re.sub(r"<[^>]+>", "", part)), part
    for part in ('<div class="ad">Buy this thing now, while it is cheap.</div>', '<ul class="related-links"><li><a href=x>Another story of ours</a></li></ul>', '<div id="commentList"><p>A reader says so at length.</p></div>'):
        assert html_text.main_text(f"<body><article><h1>Head</h1>{body}{part}</article></body>").endswith("as stories do."), part


def test_time_is_linear_whatever_the_markup():
    n = 40_000
    pages = ["<i>" * n + "</b>" * n, "<a '" * n, '<a b="' * n, "<div>" * n + "<li>" * n, "<b>" * n + "<div>" + "</b>" * n, "<script" * n, "<a b='>' " * n, "<script>" + "</script" * n, "<!--" * n, "<" * n, "<p><i>" * n, "<table><tr><td>" * n, "<noscript>" * n + "x", "&" * n, "<div class='" + "a " * n + "'>x"]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 5, page[:30]
    assert html_text.main_text("<article><p>" + "word " * 300_000 + "</p></article>").count("word") == 300_000


def test_form_around_a_page_is_no_form():
    story = "<p>A paragraph of a story that goes on for quite some time, as stories do.</p>" * 4
    fields = '<input type="hidden" name="state"><div class="search"><input><button>Go</button></div>'
    for page in (f'<body><form id="aspnet" action=x>{fields}<nav>menu</nav><div><h1>Head</h1>{story}</div></form></body>', f"<body><form><article><h1>Head</h1>{story}</article></form></body>", f"<body><nav>menu</nav><form>{fields}<main><h1>Head</h1>{story}</main></form><footer>foot</footer></body>"):
        assert html_text.main_text(page).split("\n")[-4:] == ["A paragraph of a story that goes on for quite some time, as stories do."] * 4
    ask = '<form action=x><p>Write to us</p><label>Name</label><input><textarea></textarea><button>Send</button></form>'
    assert html_text.main_text(f"<body><article><h1>Head</h1>{story}{ask}</article></body>").endswith("as stories do.")
    assert html_text.main_text(f"<body><article><h1>Head</h1>{story}</article>{ask}</body>").endswith("as stories do.")
    # An aside is a sidebar, also within an article.
    assert html_text.main_text(f"<body><article><h1>Head</h1>{story}<aside>Said aside.</aside></article></body>").endswith("as stories do.")
