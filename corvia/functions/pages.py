"""Web pages of a documentation site: the article, its title and hierarchy, the pages it leads to, and its markdown.

A page is read into a small tree by the standard parser. Selectors are names of elements with classes, ids and
attributes, in chains of descendants; lists of them are tried in order.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "figure", "dl", "dt", "dd", "hr", "header", "footer", "tr", "li", *(f"h{i}" for i in range(1, 7))}
#: Elements inside each other beyond which only their text is taken.
DEEPEST = 200
LEAST = 20


@dataclass
class Options:
    """What tells a site's articles, titles, parents and own pages."""

    article: list[str] = field(default_factory=lambda: ["article", "main", "body"])
    title: list[str] = field(default_factory=lambda: ["h1", "title"])
    parents: list[str] = field(default_factory=lambda: [".breadcrumb a"])
    unwanted: list[str] = field(default_factory=lambda: [".table-expand-btn"])
    hosts: list[str] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=lambda: ["/"])
    pattern: str = ""
    source_label: str = "Source"
    id_label: str = "Id"
    #: Whether a character reference counts without its semicolon, as browsers read it; else what is cut off stays as it is.
    open_references: bool = True


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        todo: list[Node] = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, between: str = " ") -> str:
        """The stripped texts inside, joined."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                if node.strip():
                    out.append(node.strip())
            elif node.tag not in DROPPED:
                todo.extend(reversed(node.children))
        return between.join(out)

    def matches(self, simple: tuple) -> bool:
        tag, classes, ids, attrs = simple
        own = (self.attrs.get("class") or "").split()
        return (not tag or tag == self.tag) and all(c in own for c in classes) and all(i == self.attrs.get("id") for i in ids) and all(a in self.attrs and (v is None or self.attrs[a] == v) for a, v in attrs)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "td", "th", "tr") and self.at.tag == tag:  # such an element ends where the next begins
            self.at = self.at.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.children.append(data)


def closed_references(html: str) -> str:
    """The page with its ampersands escaped that begin no reference with a semicolon."""
    known = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:]
    return re.sub(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?", known, html)


def tree(html: str, open_references: bool = True) -> Node:
    builder = _Builder()
    builder.feed(html if open_references else closed_references(html))
    builder.close()
    return builder.root


def _simple(part: str) -> tuple:
    tag = re.match(r"[a-zA-Z][\w-]*", part)
    attrs = [(a, v.strip("\"'") if v else None) for a, v in re.findall(r"\[([\w-]+)(?:=([^\]]*))?\]", part)]
    bare = re.sub(r"\[[^\]]*\]", "", part)
    return (tag[0].lower() if tag else "", re.findall(r"\.([\w-]+)", bare), re.findall(r"#([\w-]+)", bare), attrs)


def select(root: Node, selector: str) -> list[Node]:
    """Nodes below root that a chain of descendants names, in the order of the page; commas part alternatives."""
    chains = [[_simple(p) for p in alternative.split()] for alternative in selector.split(",")]

    def fits(node: Node, chain: list[tuple]) -> bool:
        if not chain or not node.matches(chain[-1]):
            return False
        rest, at = len(chain) - 2, node.up
        while rest >= 0 and at is not None:
            if at.matches(chain[rest]):
                rest -= 1
            at = at.up
        return rest < 0

    return [n for n in root.walk() if n is not root and any(fits(n, c) for c in chains)]


def hierarchy_key(label: str) -> str:
    return re.sub(r"[\s_\-()（）]+", "", unicodedata.normalize("NFC", label).casefold())


def page_id(uri: str) -> str:
    return re.sub(r"\.[^.]*$", "", urlsplit(uri).path.rsplit("/", 1)[-1])


def canonical(uri: str) -> str:
    parts = urlsplit(uri)
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{parts.path}"


def allowed(uri: str, options: Options) -> bool:
    """Whether a page belongs to the site: scheme, host, path and file name."""
    parts = urlsplit(uri)
    return parts.scheme in ("http", "https") and (not options.hosts or parts.netloc in {h.casefold() for h in options.hosts}) and any(parts.path.startswith(p) for p in options.prefixes) and re.search(options.pattern, parts.path.rsplit("/", 1)[-1]) is not None


def article_of(root: Node, uri: str, title_hint: str, options: Options) -> Node:
    """The article whose title or title's id is the page's id or hint; else the only one there is."""
    for selector in options.article:
        if found := select(root, selector):
            break
    else:
        raise ValueError("no article")
    wanted = {w.casefold() for w in (page_id(uri), title_hint.strip()) if w}
    for node in found:
        for selector in options.title:
            for heading in select(node, selector)[:1]:
                if heading.text().casefold() in wanted or (heading.attrs.get("id") or "").strip().casefold() in wanted:
                    return node
    if len(found) > 1:
        raise ValueError(f"{len(found)} articles and none of this page")
    return found[0]


def title_of(root: Node, article: Node, title_hint: str, options: Options) -> str:
    for selector in options.title:
        for node in (select(article, selector) or select(root, selector))[:1]:
            if text := node.text():
                return text
    if title_hint:
        return title_hint
    raise ValueError("no title")


def hierarchy_of(root: Node, title: str, known: list[str], has_path: bool, labels: dict[str, str], options: Options) -> list[str]:
    """A known page's own hierarchy; else the known labels in the page's title, from the end; else its parent links."""
    if has_path and known:
        return known
    head = [n.text() for n in select(root, "title")][:1]
    found: list[str] = []
    for part in [p.strip() for p in re.split(r"\s*-\s*", head[0] if head else "") if p.strip()][1:]:
        label = labels.get(hierarchy_key(part))
        if label and label not in found:
            found.append(label)
    if found:
        return found[::-1]
    for selector in options.parents:
        for node in select(root, selector):
            label = node.text()
            if label and label != title and label not in found:
                found.append(label)
    return found


def links_of(article: Node, uri: str, options: Options) -> list[tuple[str, str]]:
    """(uri, text) of the site's other pages that an article leads to, each once, the last text."""
    own, found = canonical(uri), {}
    for node in select(article, "a[href]"):
        href = node.attrs["href"].strip()
        if not href or href.startswith("#"):
            continue
        target = canonical(urljoin(uri, href))
        if target != own and allowed(target, options):
            found[target] = node.text()
    return list(found.items())


def formula(node: Node) -> str:
    """A formula as LaTeX between dollars if the page has it, else as code."""
    latex = [n.text("") for n in select(node, 'annotation[encoding="application/x-tex"]')][:1]
    seen = [n.text("") for n in select(node, ".katex-html")][:1] or [node.text("")]
    value = (latex or seen)[0]
    if not value:
        return ""
    at, block = node.up, any(n.attrs.get("display", "").casefold() == "block" for n in select(node, "math"))
    while at is not None and not block:
        block, at = "katex-display" in at.attrs.get("class", "").split(), at.up
    mark = ("$$" if block else "$") if latex and latex[0] else "`"
    return f"\n\n{mark}\n{value}\n{mark}\n\n" if mark == "$$" else f"{mark}{value}{mark}"


class Markdown:
    """An article as markdown: headings by #, lists by -, links and images with whole addresses, tables by |."""

    def __init__(self, uri: str, skip: set[int]):
        self.uri, self.skip = uri, skip
        parts = urlsplit(uri)
        self.images = f"{parts.scheme}://{parts.netloc}/"

    def of(self, node: Node, depth: int = 0, pre: bool = False) -> str:
        if depth > DEEPEST:
            return node.text()
        return "".join(self.one(c, depth, pre) for c in node.children)

    def one(self, c, depth: int, pre: bool) -> str:
        if isinstance(c, str):
            return c if pre else re.sub(r"\s+", " ", c)
        tag = c.tag
        if id(c) in self.skip or tag in DROPPED:
            return ""
        if "katex" in c.attrs.get("class", "").split():
            return formula(c)
        if tag == "br":
            return "\n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "img":
            return f"![{c.attrs.get('alt', '')}]({urljoin(self.images, c.attrs['src'])})" if c.attrs.get("src") else ""
        if tag == "pre":
            return f"\n\n```\n{self.of(c, depth + 1, True).strip(chr(10))}\n```\n\n"
        if tag == "table":
            return self.table(c, depth)
        inner = self.of(c, depth + 1, pre)
        if tag == "a" and c.attrs.get("href"):
            return f"[{inner.strip()}]({urljoin(self.uri, c.attrs['href'])})" if inner.strip() else ""
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(inner.split())}\n\n" if inner.strip() else ""
        if tag in ("b", "strong", "i", "em", "code") and not pre and inner.strip():
            mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}[tag]
            return f"{mark}{inner.strip()}{mark}"
        if tag == "li":
            return "\n- " + inner.strip().replace("\n", "\n  ")
        if tag in ("ul", "ol"):
            return f"\n{inner}\n\n" if depth else f"{inner}\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {x}".rstrip() for x in inner.strip().split("\n")) + "\n\n"
        return f"\n\n{inner}\n\n" if tag in BLOCKS else inner

    def table(self, node: Node, depth: int) -> str:
        cells = lambda tr: [" ".join(self.of(c, depth + 1).split()).replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        rows = [r for r in map(cells, select(node, "tr")) if r]
        if not rows:
            return ""
        return "\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]]) + "\n\n"


def tidy(text: str) -> str:
    """NFC, line feeds, no space at line ends, two empty lines at most, one line feed at the end."""
    lines = [x.rstrip() for x in unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join(lines)).strip("\n") + "\n"


def parse(html: str, uri: str, options: Options, title_hint: str = "", known: list[str] | None = None, has_path: bool = False, labels: dict[str, str] | None = None, node_id: str = "") -> dict:
    """What a page says: title, hierarchy, links, markdown, artifact, external_id. What can't be read is a ValueError."""
    root = tree(html, options.open_references)
    article = article_of(root, uri, title_hint, options)
    title = title_of(root, article, title_hint, options)
    hierarchy = hierarchy_of(root, title, [k for k in known or [] if k.strip()], has_path, labels or {}, options)
    skip = {id(n) for s in options.unwanted for n in select(article, s)}
    for selector in options.title:
        if own := [n for n in select(article, selector)[:1] if n.text() == title]:
            skip.add(id(own[0]))
            break
    body = tidy(Markdown(uri, skip).of(article))
    if len(body.strip()) < LEAST:
        raise ValueError("the article is too short")
    anchors = [n.attrs["name"].strip() for n in select(article, "a[name]")][:1]
    external = node_id.strip() or (anchors[0] if anchors else "") or page_id(uri)
    own = canonical(uri)
    artifact = f"# {title}\n\n> {options.source_label}: {own}\n> {options.id_label}: `{external}`\n\n---\n\n{body}"
    return {"title": title, "hierarchy": hierarchy, "links": links_of(article, uri, options), "markdown": tidy(f"# {title}\n\n{body}"), "artifact": tidy(artifact), "external_id": external, "canonical_uri": own, "needs_classification": not hierarchy}


SCHEMA = "canonical_uri string, title string, hierarchy array<string>, links array<struct<uri string, text string>>, markdown string, artifact string, external_id string, needs_classification boolean, error string"


def parse_pages(pages: DataFrame, keep: list[str], options: Options | None = None, labels: dict[str, str] | None = None, uri_col: str = "uri", html_col: str = "html") -> DataFrame:
    """keep and what each page says; a page that can't be read is a row with its error.

    pages may also have title_hint, hierarchy (of a known reference), has_path, node_id, status_code and content_type;
    other answers than 200 and other types than HTML are errors. labels: ``sync.hierarchy_labels`` as a mapping.
    """
    options, labels = options or Options(), labels or {}
    more = {"title_hint": F.lit(""), "hierarchy": F.array().cast("array<string>"), "has_path": F.lit(False), "node_id": F.lit(""), "status_code": F.lit(200), "content_type": F.lit("text/html")}
    given = [F.coalesce(F.col(c), d).alias(f"_{c}") if c in pages.columns else d.alias(f"_{c}") for c, d in more.items()]
    columns = [f"_{c}" for c in more]
    names = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", SCHEMA)]

    def one(uri, html, hint, known, has_path, node, status, kind) -> tuple:
        if status != 200:
            return (*[None] * 8, f"HTTP {status}")
        if kind.split(";")[0].strip() not in ("text/html", "application/xhtml+xml", ""):
            return (*[None] * 8, f"not HTML: {kind}")
        try:
            r = parse(html or "", uri or "", options, hint, list(known), bool(has_path), labels, node)
        except (ValueError, AssertionError) as e:
            return (*[None] * 8, str(e))
        return (*(r[n] if n != "links" else [{"uri": u, "text": t} for u, t in r["links"]] for n in names[:-1]), None)

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(*row) for row in zip(part["_uri"], part["_html"], *(part[c] for c in columns), strict=True)]
            yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    kinds = dict(pages.dtypes)
    return pages.select(*keep, F.col(uri_col).alias("_uri"), F.col(html_col).alias("_html"), *given).mapInPandas(of, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), SCHEMA]))
