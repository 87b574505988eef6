"""Main text: the given pages against their articles, and made-up layouts."""

import html
import re
import time

import duckdb

from wildtally.llm import main_text as M

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header><h2>Site</h2></header><div id="wrap"><div class="menu"><a href=x>One</a> <a href=y>Two</a></div>
<div id="cookie-notice">We use cookies for a better experience of all our readers everywhere in the world.</div>
<div id="content"><h1>Title</h1><p>First long paragraph of <i>text</i> with <a href=z>a link</a> in it, and more &amp; more words &eacute; to make it long.</p><p>Short.</p>
<p>Another long paragraph of words with many letters<br>and no links at all in this line.</p><form><input name=q><button>Go</button></form><script>var x = "<p>no</p>";</script></div>
<div class="comments"><p>I am a reader and I like this article very much, thank you for all the long text.</p></div><aside>About us and more</aside></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "Title First long paragraph of text with a link in it, and more & more words é to make it long. Short. Another long paragraph of words with many letters and no links at all in this line."


def test_layouts():
    assert M.main_text(PAGE) == TEXT
    assert M.main_text(PAGE.replace('<div id="content">', "<main><header>").replace("</script></div>", "</script></main>")) == TEXT
    assert M.main_text(PAGE.split("<div class=\"comments\">")[0]) == TEXT  # broken off
    for page, text in [("", ""), ("<", "<"), ("<p>", ""), ("plain &lt; text", "plain < text"), ("<nav>a</nav>", ""), ("a<br>b", "a b"), ("<p>a<b>b</b>c<p>d", "abc d"), ("<ul>" * 3000 + "deep", "deep")]:
        assert M.main_text(page) == text


def test_given_pages():
    for page, in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        article = re.sub(r"<[^>]*>", "\x01", re.sub(r"</?(?:b|i|a)>", "", article))
        assert M.main_text(page) == " ".join(html.unescape(article).replace("\x01", " ").split())


WRAPPERS = ['<div class="content has-sidebar">', '<div id="page" class="with-comments">', "<form>", '<form><div class="search-page widget">', '<section role="search">']


def wrapped(page, opening):
    """The page with all of its body inside ``opening``."""
    tags = re.findall(r"<(\w+)", opening)
    return re.sub(r"(<body[^>]*>)(.*?)(</body>|\Z)", lambda m: m[1] + opening + m[2] + "".join(f"</{t}>" for t in reversed(tags)) + m[3], page, flags=re.S)


def test_wrappers_with_hints():
    pages = [p for (p,) in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for opening in WRAPPERS:
        for page in pages:
            assert wrapped(page, opening) != page
            assert M.main_text(wrapped(page, opening)) == M.main_text(page) != ""
        assert M.main_text(wrapped(PAGE, opening)) == TEXT


def test_remarks_longer_than_the_article():
    remarks = '<div class="comments">' + "<article class=comment><p>A reader wrote this long remark about all of it.</p></article>" * 30 + "</div>"
    for opening, closing in [("<article>", "</article>"), ("<main>", "</main>")]:
        assert M.main_text(f"<body>{opening}<h1>Title</h1><p>The text of the article itself.</p>{closing}{remarks}</body>") == "Title The text of the article itself."
    flat = '<div class="comments">' + "<p>A reader wrote this long remark about all of it.</p>" * 30 + "</div>"
    assert M.main_text(f"<body><div><h1>Title</h1><p>The text of the article itself.</p></div>{flat}</body>") == "Title The text of the article itself."


def test_deep_nesting_is_linear():
    depth = 100_000
    for page in ("<div>" * depth + "deep" + "</div>" * depth, "<div>" * depth + "</section>" * depth + "deep", "<div class=menu>" * depth + "deep"):
        began = time.monotonic()
        assert M.main_text(page) == "deep"
        assert time.monotonic() - began < 20


def test_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x &amp; y</p>"), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "'clash' AS n_chars")
    found = [tuple(r) for r in M.extract(pages).collect()]
    assert found == [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "x & y", 5), (3, "w", "", 0)]
    assert M.extract(pages.limit(0)).collect() == []
