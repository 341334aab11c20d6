import html
import re

import pytest

from corvia.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies on this site, please accept them all.</div><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></ul></nav>
%s
<div id="comments"><h3>Comments</h3><p>A very long comment of a reader, longer than the article that it stands under, by far and by intent.</p></div>
<aside>related</aside><form><p>Sign up here</p></form><footer>&copy; 2020</footer></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h1>Title &amp; more</h1><p>First <b>para</b>graph\n with &lt;b&gt;.<p>Second.<div class='ad'>Buy now</div><p>End.</article>",
    "<main><h1>Title &amp; more</h1><p>First <b>para</b>graph\n with &lt;b&gt;.<p>Second.<aside>Buy</aside><p>End.</main>",
    "<div id='main-content'><h1>Title &amp; more</h1><p>First <b>para</b>graph\n with &lt;b&gt;.</p><!-- no > --><p>Second.</p><p>End.</p></div>",
    "<div><h1>Title &amp; more</h1><p>First <b>para</b>graph\n with &lt;b&gt;.<p>Second.<p>End.</div>",
])
def test_articles(body):
    assert H.main_text(PAGE % body) == "Title & more First paragraph with <b>. Second. End."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b <b>c<p>d", "a b c d"), ("<p>a &nbsp; b</p><!-- open", "a b"), ("<p", "<p"), ("<article></article>", ""), ("<script>x</script>", ""), ("a < b &amp;amp; c", "a < b &amp; c"),
])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_stored_pages(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.query(rows).collect()}
    for r in rows.collect():
        inside = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:h1|p|br)>", inside))
        want = " ".join(b for b in blocks if b)
        assert found[r["page_id"]] == (want, len(want))


def test_tables(spark):
    frame = spark.createDataFrame([(1, "u", None, "clash"), (None, None, "<p>x</p>", "clash"), (2, "u", "<p>" + "long text " * 100_000, "clash")], "page_id long, url string, html string, text string")
    assert sorted((r["n_chars"] for r in H.query(frame).collect())) == [0, 1, 999_999]
    assert H.query(frame.limit(0)).count() == 0


@pytest.mark.parametrize(("tag", "away"), [
    ('div class="main-nav"', True), ('div class="page-header"', True), ('div class="entry-header"', False), ('div class="content with-sidebar"', False), ('div id="commentList"', True), ('div class="post-comments"', True),
    ('article class="post comments-open"', False), ('article class="comment"', True), ('div role="navigation"', True), ('div class="text"', False), ('p class="lead"', False), ("div style='display: none'", True),
    ('div class="article-body"', False), ('div class="sideBar"', True), ('div class="site-footer"', True), ('section class="reader-comments"', True), ('div class="shadow"', False), ('div class="download"', False),
])
def test_what_is_no_content(tag, away):
    name, _, attributes = tag.partition(" ")
    assert H.is_away(name, attributes) == away


def test_containers():
    page = "<body><div id=wrap><div class=content><h1>T</h1><p>one two</p><div class=share>x</div><p>three</p></div><div class='col side'>" + "<p>link list</p>" * 9 + "</div></div>"
    assert H.main_text(page) == "T one two three"
