import time

import pytest

from corvia.llm import html as H

LONG = "A paragraph of the article that is long enough to make the sums of the windows surge, with some more words to be sure. "


@pytest.mark.parametrize(("page", "text"), [
    # a list of links inside the article is its own, one outside isn't, as only the windows tell
    (f"<article><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul><p>Its end.</p></article>", LONG + "One Two Three Four Its end."),
    (f"<article><p>{LONG}</p><ol><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a><li><a href=5>Five</a></ol></article>", LONG + "One Two Three Four Five"),
    (f"<body><div><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a><li><a href=4>Four</a></ul></div></body>", LONG),
    ("<nav><a href=0>Menu</a></nav><article><p><a href=1>All of it is a link.</a></p></article>", "All of it is a link."),
    # a link or two are text
    (f"<article><p>{LONG}</p><p><a href=1>One</a></p><p>Its end.</p><p><a href=2>Source</a></p></article>", LONG + "One Its end. Source"),
    # a content element without a surge beside text that surges
    (f"<body><div class=content>Loading</div><div><p>{LONG}</p><p>{LONG}</p></div></body>", (LONG * 2).strip()),
    # nothing is named: short stretches around the article don't surge
    (f"<body><div>Home of the site</div><div><h1>Title</h1><p>{LONG}</p><p>Short.</p></div><div>All rights reserved</div></body>", f"Title {LONG}Short."),
    # a heading right before, and a short part between two of one parent
    (f"<body><div id=x><div><h2>Title</h2></div><div>{LONG}</div><div>short</div><div>{LONG}</div></div><div>imprint</div></body>", f"Title {LONG}short {LONG}".strip()),
    # content around and next to the article
    (f"<main><h1>Title</h1><p>Lead</p><article><p>{LONG}</p></article></main>", f"Title Lead {LONG}".strip()),
    (f"<body><div class=post-title>Title</div><div class=post-body>{LONG}</div><div class=post-body>End.</div></body>", f"Title {LONG}End."),
    (f"<article><p>{LONG}</p><div class=ad>Buy</div><p>Short end.</p></article>", f"{LONG}Short end."),
    (f"<article><div class=entry-content><section><p>{LONG}</p></section><section><p>Two words</p></section></div></article>", f"{LONG}Two words"),
    ("<body><nav>Menu</nav><article><p>Tiny.</p></article><footer>foot</footer></body>", "Tiny."),
    # elements without an end take no more than the element around them
    (f"<article><p>{LONG}<svg><path></p><p>Next.</p><div><noscript>x</div><p>End.</p></article>", f"{LONG}Next. End."),
    ('<p>a</p><a href="x" <b>bold</b>', "a bold"),
])
def test_windows_choose(page, text):
    assert H.main_text(page) == " ".join(text.split())


def test_without_windows_the_result_is_another(monkeypatch):
    page = f"<div><p>{LONG}</p><ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul></div><div><p>Elsewhere</p></div>"
    with_windows = H.main_text(page)
    monkeypatch.setattr(H, "runs_of", lambda lines: [H.Run(0, len(lines) - 1, 1, 0)])
    assert H.main_text(page) != with_windows


def reading(page):
    """The least of three times: others may be at work on the machine."""
    took = []
    for _ in range(3):
        began = time.process_time()
        H.main_text(page)
        took.append(time.process_time() - began)
    return min(took)


@pytest.mark.parametrize("parts", [("<a ", 40_000), ("<div>", 20_000, "</span>", 20_000), ("<b><div>", 8_000, "</b>", 16_000), ("<p><i>", 12_000, "</i></p>", 12_000), ('<a "', 40_000), ("<li><a href=x>link</a>", 8_000), ("<!-- ", 40_000), ("<td>", 20_000)])
def test_time_is_linear(parts):
    """Four times the page takes about four times as long, not sixteen times."""
    made = lambda times: "".join(x * (n * times) for x, n in zip(parts[::2], parts[1::2], strict=True))
    assert reading(made(4)) < 9 * reading(made(1)) + 0.2


def test_windows():
    weights = [0, 5, 0, 7, 0, 0, 0, 9, 0]
    lines = []
    for w in weights:
        line = H.Line(1)
        line.text = "x" * w
        lines.append(line)
    assert [(r.first, r.last, r.peak) for r in H.runs_of(lines)] == [(1, 3, 12), (7, 7, 9)]


@pytest.mark.parametrize("part", [
    "<section id='related-work'>Others have done so too.</section>", "<section id='responses'>They said yes.</section>", "<h2 id='social-history'>Social history</h2>", "<p class='notice-period'>A month.</p>",
    "<p>An <span class='alert'>urgent</span> word.</p>", "<div class='widgets-intro'>Widgets are small.</div>", "<p id='comments'>Of a comment.</p>", "<ul><li><a href=x>Only a link</a></ul>", "<h3 class='menu'>Menu of the day</h3>",
    "<div class='ad-hoc'>Made for it.</div>", "<table><tr><td id='footer-note'>Note</td></tr></table>", "<blockquote class='quote share-price'>It fell.</blockquote>",
])
def test_an_articles_own_parts_stay(part):
    import re

    words = " ".join(re.sub("<[^>]*>", "", part).split())
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id='wrap'><div class=entry><div>{}</div></div></div>"):
        page = "<body><nav>Menu</nav>" + around.format(f"<p>{LONG}</p>{part}<p>Its end.</p>") + "<footer>Foot</footer></body>"
        assert H.main_text(page) == f"{LONG}{words} Its end.", around


@pytest.mark.parametrize("part", [
    "<div class=ad>Buy</div>", "<div class='ad-300x250'>Buy</div>", "<div class='adsByGoogle'>Buy</div>", "<div id='comments'><p>A reader's word.</p></div>", "<section class='reader-comments'><p>Mine.</p></section>", "<ol class='comment-list'><li>Mine</ol>",
    "<div class='related-posts'>Others</div>", "<div class='social-share-buttons'>Tell it</div>", "<div class='cookie-notice'>We use them</div>", "<div class=notice>Old</div>", "<aside>By the way</aside>", "<form>Your name</form>", "<nav>1 2 3</nav>",
    "<footer>By me</footer>", "<ul class='breadcrumbs'><li>Home</ul>", "<div class='newsletter-signup'>Sign up</div>", "<p class='advertisement'>Buy</p>", "<p hidden>Not yet</p>", "<article class=comment>Mine</article>", "<div id=sidebar>Beside</div>",
    "<header class='site-header'>The site</header>", "<script>x</script>", "<style>y</style>", "<div role=navigation>Next</div>",
])
def test_furniture_in_an_article_goes(part):
    for around in ("<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>"):
        page = "<body><nav>Menu</nav>" + around.format(f"<p>{LONG}</p>{part}<p>Its end.</p>") + "<footer>Foot</footer></body>"
        assert H.main_text(page) == f"{LONG}Its end.", around


def test_headers_of_articles():
    for around in ("<article>{}</article>", "<div class=content>{}</div>", "<main><div>{}</div></main>"):
        page = "<body><header><h1>Site</h1></header>" + around.format(f"<header><h1>Title</h1></header><p>{LONG}</p>") + "</body>"
        assert H.main_text(page) == f"Title {LONG}".strip(), around
