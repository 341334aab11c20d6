"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of text. A line weighs as many characters as it has outside links, and
nothing if most of it is links; inside a content element links are text. Weights are summed over sliding windows of
``WINDOW`` lines. Elements that are never content (menus, headers, footers, sidebars, forms, adverts, notices, comments
by readers, scripts, styles) leave nothing; the edges of sections, which are stretches of mere markup, leave a window of
empty lines. Outside content elements a part of a name tells such an element. Inside one (an article, a main element or
one named as such) a name must speak of furniture as a whole: ``related-posts`` does, ``related-work`` doesn't; names of
headings and inline elements say nothing there, nor do ids of sections and paragraphs, and a header is the article's.

The windows choose the text. A run goes from where the sum rises from 0 to the dive point where it is 0 again; it
surges if its highest window reaches ``SURGE`` characters and ``SHARE`` of the page's highest window (or is that window).
Text between a surge and its dive is kept, so a menu of links outside content elements, over which windows are 0, goes.
What doesn't surge is kept beside a run that does, if it belongs to the same article: in the same section, in a content
element (article, main, or one that is named so) around, inside or next to the run's own, between two kept runs of one
parent, or a heading right before one. So nothing of an article is lost to a length limit.

Pages are read by one regular expression, tag by tag, with the last place of each open element at hand, in time linear
in the page; unclosed and crossed tags, unclosed comments and missing ends are allowed. A tag without its end stops
where the next one begins. As in the HTML standard, an unclosed script, style, textarea or title takes the rest of the
page; other elements that are left out end with the element around them at the latest.

Defined results: null and empty pages have an empty text; repeated rows stay; of equal highest windows all surge; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import per_text

#: Lines in the sliding window.
WINDOW = 3
#: Characters of a window, and their share of the page's highest one, from which on it is a surge.
SURGE, SHARE = 80, 0.1
#: Share of links from which on a line is no text.
LINKS = 0.5

TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)(?:>|(?=<))""", re.S)
ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Element names of the HTML standard by what they are for.
RAW = {"script", "style", "textarea", "title"}
NEVER = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "canvas", "audio", "video", "noscript", "template", "iframe", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"p", "div", "article", "section", "main", "ul", "ol", "dl", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "figure", "nav", "header", "footer", "aside", "form"}
EMBEDDED = {"noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "button", "select"}
MAIN = {"article", "main"}
SECTIONS = {"div", "section", "td", "body", *MAIN}
HEADINGS = {"h1", "h2", "h3"}
#: Parts of class, id and role names. A name with a part of OUT is no content; one that ends in a part of EDGE is none
#: unless it begins with a part of STAY (an article's own header); one with a part of BESIDE only speaks of another element.
OUT = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promoted", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "footer", "colophon", "sidebar", "sidebars", "complementary", "contentinfo", "related", "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "responses", "share", "sharing", "social", "subscribe", "newsletter", "signup", "login", "pager", "pagination", "toolbar", "widget", "widgets", "skip"}
EDGE = {"header", "masthead", "head", "side", "aside", "rail", "search", "form", "foot"}
STAY = {"article", "content", "main", "post", "entry", "story", "body", "page", "text"}
OWN = STAY - {"page", "body", "main", "text"}
#: Further parts that a name of furniture inside a content element may have beside a part of OUT or INSIDE; numbers and
#: single letters may be there too.
INSIDE = {"aside", "rail", "search", "side", "foot"}
FILLER = {"area", "article", "articles", "author", "bar", "block", "blocks", "body", "bottom", "box", "button", "buttons", "by", "card", "cards", "center", "content", "container", "count", "entry", "floating", "form", "google", "group", "header", "hero", "icons", "inline", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "media", "meta", "mobile", "module", "more", "native", "news", "outer", "page", "panel", "placeholder", "post", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "site", "slot", "sticky", "stories", "story", "text", "thread", "title", "top", "unit", "user", "video", "wrap", "wrapper"}
NAMELESS = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Parts of a header's names inside a content element that make it the site's.
SITE = {"site", "global", "masthead", "nav", "navbar", "navigation", "menu"}
BESIDE = {"with", "has", "no", "without", "open", "closed", "enabled"}
#: Class names of articles that are readers' comments, adverts or pointers to other articles.
OTHER_ARTICLES = {"comment", "comments", "comment-body", "comment-content", "reply", "ad", "advert", "advertisement", "sponsored", "promo", "related", "teaser"}
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
RAW_END = {name: re.compile(rf"(?i)</{name}\s*>") for name in RAW}
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


class Line:
    __slots__ = ("heading", "home", "linked", "parts", "text")

    def __init__(self, home: int, heading: bool = False):
        self.home, self.heading, self.parts, self.linked, self.text = home, heading, [], 0, ""

    def weight(self) -> int:
        """The characters outside links; none if most are links."""
        return 0 if self.linked > LINKS * len(self.text) else len(self.text) - self.linked


class Section:
    """An element that may hold an article's text: the section around it, whether it is a content element, and whether it
    is inside an element (or one itself) that holds just an article."""

    __slots__ = ("content", "inside", "up")

    def __init__(self, up: int, content: bool, inside: bool = False):
        self.up, self.content, self.inside = up, content, inside


def named(attributes: str) -> Iterator[tuple[str, str, list[str]]]:
    """Each name in class, id and role, with the attribute and the name's parts in lower case."""
    for key, value in ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role"):
            for name in value.strip("\"'").split():
                yield key.lower(), name.lower(), [p.lower() for p in PART.findall(name)]


def is_away(element: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element, inside or outside a content element, is never content, by its name or attributes."""
    if element in NEVER and not (inside and element == "header"):
        return True
    if not attributes or element in ("html", "body"):
        return False
    for key, name, parts in named(attributes):
        if element in MAIN:
            if name in OTHER_ARTICLES:
                return True
        elif not parts or BESIDE.intersection(parts):
            continue
        elif not inside:
            if OUT.intersection([*parts, "".join(parts)]) or parts[-1] in EDGE and parts[0] not in OWN:
                return True
        elif element == "header":
            if SITE.intersection(parts):
                return True
        elif element not in NAMELESS and not (key == "id" and element in ("section", "p")) and is_furniture(parts):
            return True
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and HIDDEN.search(value):
            return True
    return False


def is_furniture(parts: list[str]) -> bool:
    """Whether a name as a whole speaks of what stands in or beside articles without being theirs."""
    said = [p for p in parts if p in OUT or p in INSIDE]
    if "".join(parts) in OUT:
        return True
    return bool(said) and all(p in OUT or p in INSIDE or p in FILLER or p.isdigit() or len(p) == 1 for p in parts)


def is_main(element: str, attributes: str) -> bool:
    """Whether an element may hold the article."""
    return element in MAIN or element in ("div", "section", "td") and any(STAY.intersection(parts) for _, _, parts in named(attributes))


def is_own(element: str, attributes: str) -> bool:
    """Whether an element holds just the article."""
    return element in MAIN or element in ("div", "section", "td") and any(OWN.intersection(parts) for _, _, parts in named(attributes))


class Stack:
    """Open elements, with the places of those that closing tags ask for."""

    def __init__(self):
        self.items: list[tuple[str, bool, int]] = []  # name, left out, section outside
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of elements that are neither inline nor paragraphs
        self.out: list[int] = []  # places of elements that are left out

    def push(self, name: str, out: bool, home: int) -> None:
        at = len(self.items)
        self.items.append((name, out, home))
        self.places.setdefault(name, []).append(at)
        if name != "p" and name not in INLINE:
            self.blocks.append(at)
        if out:
            self.out.append(at)

    def pop(self) -> tuple[str, bool, int]:
        item = self.items.pop()
        at = self.places[item[0]].pop()
        for places in (self.blocks, self.out):
            if places and places[-1] == at:
                places.pop()
        return item

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def closed_by(self, name: str) -> int:
        """Where the closing tag's element is; -1 if the tag closes nothing.

        A closing inline tag doesn't end blocks, and a stray end of a paragraph no block that is left out.
        """
        at = self.last(name)
        if at >= 0 and name in INLINE and self.blocks and self.blocks[-1] > at:
            return -1
        stray = name == "p" and self.out and self.out[-1] > at and self.items[self.out[-1]][0] not in EMBEDDED
        return -1 if stray else at


def lines_of(page: str) -> tuple[list[Line], list[Section]]:
    """The page's lines of text in order, with a window of empty ones where a section begins or ends; and the sections."""
    sections, stack = [Section(0, False)], Stack()
    lines = [Line(0)]
    home, links, at = 0, 0, 0

    def end_line(heading: bool = False) -> None:
        if lines[-1].parts or lines[-1].home != home:
            lines.append(Line(home, heading))
        elif heading:
            lines[-1].heading = True

    def gap() -> None:
        if len(lines) > WINDOW and not any(x.parts for x in lines[-WINDOW - 1 :]):
            lines[-1] = Line(home)  # one gap will do for edges without text between
        else:
            lines.extend(Line(home) for _ in range(WINDOW + 1))

    def put(text: str) -> None:
        if text and not stack.out:
            lines[-1].parts.append(text)
            if links and not sections[home].inside:
                lines[-1].linked += len(text)

    def leave(depth: int) -> None:
        nonlocal links, home
        while len(stack.items) > depth:
            name, _, outer = stack.pop()
            links -= name == "a"
            if outer != home:
                home = outer
                gap()

    for m in TAG.finditer(page):
        if m.start() < at:
            continue
        put(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing, alone = m[2].lower(), bool(m[1]), m[3].endswith("/")
        if name in RAW and not closing and not alone:
            end = RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        inline = name in INLINE
        if not inline and not stack.out:
            end_line()
        if closing:
            depth = stack.closed_by(name)
            if depth >= 0:
                leave(depth)
                if not inline and not stack.out:
                    end_line()
        elif name not in VOID and not alone:
            if name in CLOSES_P:  # a paragraph ends where a block begins, with its inline elements
                depth = stack.last("p")
                if depth >= 0 and not (stack.blocks and stack.blocks[-1] > depth):
                    leave(depth)
            if name == "li" and stack.items and stack.items[-1][0] == "li":
                leave(len(stack.items) - 1)
            out = is_away(name, m[3], sections[home].inside)
            stack.push(name, out, home)
            links += name == "a"
            if not stack.out and name in SECTIONS:
                sections.append(Section(home, is_main(name, m[3]), sections[home].inside or is_own(name, m[3])))
                home = len(sections) - 1
                gap()
            elif not stack.out and not inline:
                end_line(name in HEADINGS)
    put(page[at:])
    for line in lines:
        if line.parts:
            line.text = " ".join(unescape("".join(line.parts)).split())
    return lines, sections


class Run:
    """Lines first to last between two dive points, in one section, and the sum of their highest window."""

    __slots__ = ("first", "home", "last", "peak")

    def __init__(self, first: int, last: int, peak: int, home: int):
        self.first, self.last, self.peak, self.home = first, last, peak, home


def runs_of(lines: list[Line]) -> list[Run]:
    """The runs of lines between a rise of the windows' sums from 0 and the next dive.

    The window at i holds the lines i to i + WINDOW - 1. At a dive the run ends with its last line; lines of links that
    are fewer than a window stay with the run that they stand in or beside.
    """
    weights = [x.weight() for x in lines]
    n, runs, i = len(lines), [], 0
    sums, held = [0] * n, 0
    for j in range(n - 1, -1, -1):
        held += weights[j] - (weights[j + WINDOW] if j + WINDOW < n else 0)
        sums[j] = held
    while i < n:
        if not weights[i]:
            i += 1
            continue
        j, last, peak = i, i, 0
        while j < n and sums[j]:
            peak = max(peak, sums[j])
            last = j if weights[j] else last
            j += 1
        first = i
        for step, end in ((-1, -1), (1, n)):  # a few lines of links at an edge, up to a gap or another run
            k, beside = (i if step < 0 else last) + step, 0
            while k != end and lines[k].text and not weights[k]:
                k, beside = k + step, beside + 1
            if beside < WINDOW:
                first, last = (first - beside, last) if step < 0 else (first, last + beside)
        runs.append(Run(first, last, peak, lines[i].home))
        i = max(j, last + 1)
    return runs


def chosen(lines: list[Line], sections: list[Section]) -> list[Run]:
    """The runs that surge, and those that belong to the same article."""
    runs = runs_of(lines)
    if not runs:
        return []
    highest = max(r.peak for r in runs)
    surges = [r.peak >= min(highest, max(SURGE, SHARE * highest)) for r in runs]
    content = content_of(sections)
    size = lambda named: sum(len(x.text) for r, s in zip(runs, surges, strict=True) if s and bool(content[r.home]) == named for x in lines[r.first : r.last + 1])
    named = size(True) >= size(False)  # an article is in content elements or outside them
    surges = [s and bool(content[r.home]) == named for r, s in zip(runs, surges, strict=True)]
    homes = {r.home for r, s in zip(runs, surges, strict=True) if s}
    tops = {content[h] for h in homes} - {0}
    parents = {sections[t].up for t in tops}
    around: set[int] = set()
    for t in tops:
        while t not in around:
            around.add(t)
            t = sections[t].up
    inside = [False] * len(sections)
    for i in range(1, len(sections)):
        inside[i] = i in tops or inside[sections[i].up]
    belongs = lambda own: own and (own in around or inside[own] or sections[own].up in parents)
    kept = [bool(s or r.home in homes or belongs(content[r.home])) for r, s in zip(runs, surges, strict=True)]
    return beside(runs, kept, lines, sections) if not tops else [r for r, k in zip(runs, kept, strict=True) if k]


def content_of(sections: list[Section]) -> list[int]:
    """For each section the nearest content element, itself included; 0 if there is none."""
    found = [0] * len(sections)
    for i in range(1, len(sections)):
        found[i] = i if sections[i].content else found[sections[i].up]
    return found


def beside(runs: list[Run], kept: list[bool], lines: list[Line], sections: list[Section]) -> list[Run]:
    """Kept runs, those between two of one parent, and a heading right before one of the same parent."""
    family = lambda r: {r.home, sections[r.home].up} - {0}
    after: list[Run | None] = [None] * len(runs)
    for i in range(len(runs) - 2, -1, -1):
        after[i] = runs[i + 1] if kept[i + 1] else after[i + 1]
    found, before = [], None
    for i, r in enumerate(runs):
        if kept[i]:
            before = r
            found.append(r)
        elif after[i] and family(r) & family(after[i]):
            heads = any(x.heading for x in lines[r.first : r.last + 1]) and kept[i + 1]
            if heads or before and family(r) & family(before):
                found.append(r)
    return found


def main_text(page: str | None) -> str:
    """The article's blocks, joined by spaces."""
    if not page:
        return ""
    lines, sections = lines_of(page)
    return " ".join(x.text for r in chosen(lines, sections) for x in lines[r.first : r.last + 1] if x.text)


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns and text, the page's main text."""

    def of():
        return lambda texts: (None, [[main_text(t) for t in texts]])

    return per_text(pages, keep, F.col(html_col), [("text", pa.string())], of)


def query(pages: DataFrame) -> DataFrame:
    found = extract(pages, ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
