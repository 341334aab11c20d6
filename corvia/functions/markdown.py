"""Markdown and page functions: columns where regular expressions do, iterator pandas UDFs for line machines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import strip
from pyspark.sql import types as T

# What marks pages that are no unit of their own, and sections of an API's description.
JUNK_DIRECTORIES = [".git", ".venv", "venv", "env", "node_modules", "__pycache__", ".idea", ".ruff_cache", ".pytest_cache", ".mypy_cache", "dist", "build", ".next", ".cache"]
NAMES_OUT = ["index", "readme", "summary", "overview", "toc", "allapi", "all_api", "all-api", "all apis", "all_apis"]
NAME_ENDS = r"(列表|一览|概览|概述|总览|导航|目录|简介|前言|预留接口|(?i:readme|summary|overview|toc))$"
TITLES_OUT = ["简介", "概览", "概述", "总览", "前言", "目录", "索引", "汇总", "导航", "预留接口", "废弃接口", "Introduction", "Overview", "Preface", "Foreword", "About", "Reserved", "Reserved Interfaces", "Deprecated", "Index", "Readme", "Summary", "TOC", "Contents"]
LISTING = r"本章节列出|本章列出|本章\s*罗列|以下为(?:本)?(?:模块|章节)?(?:全部|所有)?(?:接口|API|算子|函数)|本节(?:仅)?列出"
API_SECTIONS = ["功能说明", "函数原型", "参数说明", "原型定义", "函数说明", "返回值说明", "约束说明", "调用示例", "注意事项", "需要包含的头文件", "Public成员函数", "模板参数", "参数类型", "成员函数", "字段说明", "属性说明", "Function Prototype", "Parameters", "Returns", "Description"]
EXAMPLE_HEADING = r"(?i)示例|example"
LINK_DENSITY = 0.30
LINK_LINE = r"\[[^\]]+\]\([^)]+\)|^\s*\[[^\]]+\]:\s+"


def lines(text: Column) -> Column:
    """Lines; a line feed at the end begins none."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n$", ""), r"\r?\n", -1)


def link_density(text: Column) -> Column:
    """Share of lines with a link, 0 for an empty text."""
    share = F.transform(F.array(lines(text)), lambda own: F.size(F.filter(own, lambda x: x.rlike(LINK_LINE))) / F.size(own))  # the lines, cut once
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(F.get(share, F.lit(0)))


def minimal_unit(stem: Column, text: Column, names_out: list[str] | None = None, titles_out: list[str] | None = None, listing: list[str] | None = None) -> Column:
    """struct(included, reason): whether a page describes one unit; further names, titles and listing phrases may be out.

    Names and first headings of overviews are out, and so are texts that say they list things; a fourth-level heading
    of an API's section is in; else the share of link lines decides.
    """
    title = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1))
    headings = F.regexp_extract_all(text, F.lit(r"(?m)^####[ \t]+(.+?)[ \t]*$"), F.lit(1))
    described = F.exists(headings, lambda h: h.rlike("|".join(API_SECTIONS)))
    verdict = lambda included, reason: F.struct(F.lit(included).alias("included"), F.lit(reason).alias("reason"))
    return (
        F.when(F.lower(stem).isin([*NAMES_OUT, *(names_out or [])]), verdict(False, "file name"))
        .when(stem.rlike(NAME_ENDS), verdict(False, "file name ending"))
        .when(title.isin([*TITLES_OUT, *(titles_out or [])]), verdict(False, "title"))
        .when(text.rlike("|".join([LISTING, *(listing or [])])), verdict(False, "listing"))
        .when(described, verdict(True, "api sections"))
        .when(F.coalesce(text, F.lit("")) == "", verdict(False, "empty"))
        .when(link_density(text) > LINK_DENSITY, verdict(False, "links"))
        .otherwise(verdict(True, "text"))
    )


def junk_path(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(re.escape(d) for d in JUNK_DIRECTORIES) + ")/")


def without_links(text: Column) -> Column:
    """Images go, links become their text."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]*)\]\([^)]*\)", "$1")


def image_marks(text: Column) -> Column:
    """Number of image openings."""
    return F.regexp_count(text, F.lit(r"!\["))


def sections(text: Column) -> Column:
    """array<struct(title, body)> by first-level headings."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=# )", -1), lambda p: p.rlike(r"^\n?# "))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\n?# +(.*?)[ \t]*(?:\n|$)", 1).alias("title"), F.regexp_replace(p, r"^\n?# [^\n]*\n?", "").alias("body")))


def section_after(text: Column, heading: str) -> Column:
    """What stands under a fourth-level heading."""
    return strip(F.regexp_extract(text, rf"(?ms)^####[ \t]+{heading}[ \t]*\n(.*?)(?=^#{{1,4}} |\z)", 1))


def signature_of(signature: Column, body: Column, heading: str = "(?:函数原型|Function Prototype)") -> Column:
    return F.coalesce(F.nullif(F.trim(signature), F.lit("")), F.nullif(section_after(body, heading), F.lit("")), F.lit(""))


def table_cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(row), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def parameter_table(parameters: Column) -> Column:
    """A markdown table of array<struct(name, type, description)>; pipes are escaped."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = F.transform(parameters, lambda p: F.concat(F.lit("| "), F.concat_ws(" | ", cell(p["name"]), cell(p["type"]), cell(p["description"])), F.lit(" |")))
    return F.when(F.size(parameters) > 0, F.array_join(F.concat(F.array(F.lit("| name | type | description |"), F.lit("| --- | --- | --- |")), rows), "\n")).otherwise("")


def evidence_in(value: Column, markdown: Column) -> Column:
    """Whether a value is in the text, whatever the case and white space."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    return (flat(value) != "") & F.contains(flat(markdown), flat(value))


def accepted_value(value: Column, markdown: Column, most: int, allowed: list[str] | None = None) -> Column:
    """struct(value, is_ai) of a proposed value: null if too long or not allowed, is_ai if the text doesn't hold it."""
    ok = F.trim(F.coalesce(value, F.lit(""))) != ""
    ok = ok & (F.length(value) <= most) & (value.isin(allowed) if allowed else F.lit(True))
    return F.when(ok, F.struct(F.trim(value).alias("value"), (~evidence_in(value, markdown)).alias("is_ai")))


def unfenced(response: Column) -> Column:
    """A response without its fence and what precedes it."""
    text = F.regexp_replace(response, r"(?s)<think>.*?</think>", "")
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```(?:ya?ml|json)?[ \t]*\n(.*?)\n?```", 1), F.lit("")), F.trim(text))


# Line machines


def masked(text: str) -> str:
    """The text with fenced, indented, inline and HTML code blanked; offsets stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    out, fence, before = [], "", True
    for line in text.split("\n"):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence:
            out.append(blank(line))
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line.strip(" `~"):
                fence = ""
        elif mark:
            fence = mark[1]
            out.append(blank(line))
        elif before and re.match(r"(?: {4}|\t)\S", line):
            out.append(blank(line))
            continue
        else:
            out.append(line)
        before = not line.strip()
    found = re.sub(r"(?is)<(pre|code)\b.*?</\1\s*>", lambda m: blank(m[0]), "\n".join(out))
    return re.sub(r"(`+)(?!`)(.*?)(?<!`)\1(?!`)", lambda m: blank(m[0]), found, flags=re.S)


RESOURCES = (
    ("image", re.compile(r"!\[(?P<label>[^\]\n]*)\]\(\s*<?(?P<uri>[^)\s>]+)>?[^)]*\)")),
    ("link", re.compile(r"(?<!!)\[(?P<label>[^\]\n]+)\]\(\s*<?(?P<uri>[^)\s>]+)>?[^)]*\)")),
    ("image", re.compile(r"""(?i)<img\b[^>]*?\bsrc\s*=\s*["']?(?P<uri>[^"'\s>]+)""")),
    ("video", re.compile(r"""(?i)<(?:video|source)\b[^>]*?\bsrc\s*=\s*["']?(?P<uri>[^"'\s>]+)""")),
    ("link", re.compile(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?(?P<uri>[^"'\s>]+)""")),
    ("definition", re.compile(r"(?m)^ {0,3}\[(?P<label>[^\]]+)\]:\s*<?(?P<uri>\S+?)>?\s*$")),
    ("link", re.compile(r"<(?P<uri>https?://[^>\s]+)>")),
)


def resources_of(text: str, base: str = "", context: int = 180) -> list[tuple]:
    """(resource_id, kind, uri, resolved, label, line, context) of every resource outside code, each place once, in order."""
    scan, found = masked(text), {}
    for kind, pattern in RESOURCES:
        for m in pattern.finditer(scan):
            found.setdefault(m.start("uri"), (kind, m["uri"], m.groupdict().get("label") or "", m.start()))
    out, counts = [], {}
    for _, (kind, uri, label, at) in sorted(found.items()):
        counts[kind] = counts.get(kind, 0) + 1
        around = " ".join(text[max(0, at - context // 2) : at + context // 2].split())
        resolved = uri if re.match(r"(?i)(https?:|data:)", uri) else urljoin(base, uri) if base else uri
        out.append((f"{kind}-{counts[kind]}", kind, uri, resolved, label, text.count("\n", 0, at) + 1, around))
    return out


def blocks_of(text: str, most_rows: int = 100) -> list[tuple]:
    """(kind, heading, language, first_line, body) of fences and tables; a table has at most most_rows rows."""
    out, heading, rows = [], "", text.split("\n")
    i = 0
    while i < len(rows):
        line = rows[i]
        fence = re.match(r" {0,3}(`{3,}|~{3,})\s*(\S*)", line)
        if fence:
            j = i + 1
            while j < len(rows) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", rows[j]):
                j += 1
            out.append(("code", heading, fence[2], i + 1, "\n".join(rows[i + 1 : j])))
            i = j
        elif line.lstrip().startswith("|") and i + 1 < len(rows) and re.match(r"\s*\|?\s*:?-{2,}", rows[i + 1]):
            j = i
            while j < len(rows) and rows[j].lstrip().startswith("|"):
                j += 1
            out.append(("table", heading, "", i + 1, "\n".join(rows[i : min(j, i + 2 + most_rows)])))
            i = j - 1
        elif title := re.match(r"#{1,6}\s+(.*?)\s*$", line):
            heading = title[1]
        i += 1
    return out


def _exploded(df: DataFrame, keep: list[str], text_col: str, schema: str, rows) -> DataFrame:
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for part in parts:
            found = [(i, *r) for i, t in enumerate(part["_text"]) for r in rows(t or "")]
            kept = part[keep].iloc[[f[0] for f in found]].reset_index(drop=True)
            yield pd.concat([kept, pd.DataFrame([f[1:] for f in found], columns=names)], axis=1)

    kinds = dict(df.dtypes)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInPandas(of, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), schema]))


def resources(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row for each resource of each text."""
    return _exploded(df, keep, text_col, "resource_id string, kind string, uri string, resolved string, label string, line int, context string", resources_of)


def blocks(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row for each fence and table of each text."""
    return _exploded(df, keep, text_col, "kind string, heading string, language string, first_line int, body string", blocks_of)


def example_blocks(found: DataFrame) -> DataFrame:
    return found.where((F.col("kind") == "code") & F.col("heading").rlike(EXAMPLE_HEADING))


def signatures_column(text: Column) -> Column:
    """The names that are declared in code fences, in order, once each."""
    fences = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"(?s)\n```[^\n]*\n(.*?)\n```"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(fences, lambda f: F.regexp_extract_all(f, F.lit(r"(?m)^[^\n;#/=(]*?\b([A-Za-z_]\w*)\s*\([^;{}]*\)\s*[;{]"), F.lit(1)))))


def unparsed_images(text: str) -> list[tuple]:
    """(line,) of image openings outside code that are no image."""
    scan = masked(text)
    good = {m.start() for m in RESOURCES[0][1].finditer(scan)}
    return [(scan.count("\n", 0, m.start()) + 1,) for m in re.finditer(r"(?<!\\)!\[", scan) if m.start() not in good and not re.match(r"!\[[^\]]*\]\[", scan[m.start() :])]


#: A formula between dollars, whose marks aren't those of markdown.
MATH = re.compile(r"(?s)\$\$.+?\$\$|(?<![\\$])\$(?!\s)[^$\n]+?(?<!\s)\$(?!\d)")


def preprocess(text: str, drop_code: bool = False, drop_tables: bool = False, footer: str = "") -> str:
    """A page's markdown without images, link targets, empty headings and, if asked, code and tables; code and formulas
    stay as they are, and from a line that the footer's pattern matches on nothing is kept."""
    if footer and (end := re.search(rf"(?m)^(?:{footer}).*$", text)):
        text = text[: end.start()]
    if drop_code:
        text = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,}).*?^ {0,3}\1\s*$\n?", "", text)
    if drop_tables:
        text = re.sub(r"(?m)^\s*\|.*\n?", "", text)
    code = []
    text = re.sub(r"(?ms)^ {0,3}(`{3,}|~{3,}).*?^ {0,3}\1\s*$", lambda m: code.append(m[0]) or f"\x00{len(code) - 1}\x00", text)
    text = MATH.sub(lambda m: code.append(m[0]) or f"\x00{len(code) - 1}\x00", text)
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\\([\\`*_{}\[\]()#+\-.!|<>~])", r"\1", text)
    kept = text.split("\n")
    level = lambda s: len(m[1]) if (m := re.match(r"(#{1,6})\s", s)) else 0
    out: list[str] = []
    for i, line in enumerate(kept):
        if level(line):
            after = next((x for x in kept[i + 1 :] if x.strip()), "")
            if not after or level(after) and level(after) <= level(line):
                continue
        out.append(line.rstrip())
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    return re.sub(r"\x00(\d+)\x00", lambda m: code[int(m[1])], text)


@F.pandas_udf(T.StringType())
def preprocessed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else preprocess(t))


def signatures_of(text: str, name: str) -> list[str]:
    """Declarations of name in code fences outside examples; a declaration goes on until its bracket closes."""
    out = []
    for kind, heading, _, _, body in blocks_of(text):
        if kind != "code" or re.search(EXAMPLE_HEADING, heading):
            continue
        for m in re.finditer(rf"(?m)^[^\n;#/]*\b{re.escape(name)}\s*\(", body):
            depth, end = 0, len(body)
            for i in range(m.end() - 1, len(body)):
                depth += (body[i] == "(") - (body[i] == ")")
                if not depth:
                    end = i + 1
                    break
            out.append(" ".join(body[m.start() : end].split()))
    return list(dict.fromkeys(out))


# Pages


class PageParser(HTMLParser):
    """Title, headings, links and text of a page."""

    SKIP = {"script", "style", "nav", "footer", "noscript", "template"}
    BLOCK = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "pre", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.title, self.heading, self.links, self.out, self.into = 0, [], [], [], [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "title" or tag == "h1" and not self.heading:
            self.into = tag
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        if tag in self.BLOCK:
            self.out.append("\n")
        if re.fullmatch("h[1-6]", tag) and not self.skip:
            self.out.append("#" * int(tag[1]) + " ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if tag == self.into:
            self.into = ""
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if self.into == "title":
            self.title.append(data)
        elif not self.skip:
            if self.into == "h1":
                self.heading.append(data)
            self.out.append(re.sub(r"\s+", " ", data))


def parse_page(html: str) -> tuple[str, str, list[str]]:
    """(title, markdown, links): the first heading or else the title, the text with its headings, and all links."""
    parser = PageParser()
    parser.feed(html)
    parser.close()
    title = " ".join("".join(parser.heading or parser.title).split())
    body = "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.out).split("\n")) if x.strip("# "))
    return title, body, list(dict.fromkeys(parser.links))


def pages(df: DataFrame, keep: list[str], html_col: str = "html", least: int = 20) -> DataFrame:
    """(keep, title, markdown, links, ok): ok says whether a page has a body of so many characters."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [parse_page(h or "") for h in part["_html"]]
            yield part[keep].assign(title=[f[0] for f in found], markdown=[f[1] for f in found], links=[f[2] for f in found], ok=[len(f[1]) >= least for f in found])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "title string", "markdown string", "links array<string>", "ok boolean"])
    return df.select(*keep, F.col(html_col).alias("_html")).mapInPandas(of, schema)
