"""Text, identity and URL functions as columns; pandas UDFs only where Spark has no such function (NFC, casefold)."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = "\x1f"
# Word and ideograph classes of the tokenizer.
WORD = r"[\p{L}\p{N}_]+"
IDEOGRAPHS = r"[一-鿿]+"
#: An ideograph run, or a run of word characters without ideographs.
TOKEN_RUN = r"[一-鿿]+|[\p{L}\p{N}_&&[^一-鿿]]+"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case tokens: words, and bigrams of ideograph runs that are padded with a space on each side."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit(TOKEN_RUN), F.lit(0))

    def cut(run: Column) -> Column:
        padded = F.concat(F.lit(" "), run, F.lit(" "))
        pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
        return F.when(run.rlike(r"^[一-鿿]"), pairs).otherwise(F.array(run))

    plain = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))  # the same tokens at a fraction of the cost
    return F.when(lowered.rlike(IDEOGRAPHS), F.flatten(F.transform(runs, cut))).otherwise(plain)


def words(text: Column) -> Column:
    """Lower-case word tokens, for text without ideographs."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def token_id(token: Column) -> Column:
    """The first 24 bits of the token's MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("int")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix + SHA-256 of the parts joined by the unit separator."""
    return F.concat(F.lit(prefix), sha256(F.concat_ws(UNIT, *parts)))


def source_id(wiki: Column, collection: Column, namespace: Column, version: Column, document: Column) -> Column:
    return stable_id("src_", wiki, collection, namespace, version, document)


def artifact_id(wiki: Column, namespace: Column, version: Column, kind: Column, canonical_name: Column) -> Column:
    return stable_id("art_", wiki, namespace, version, kind, canonical_name)


def edge_id(wiki: Column, source: Column, target: Column, relation: Column) -> Column:
    return stable_id("edge_", wiki, source, target, relation)


def trim_to(text: Column, limit: int) -> Column:
    """Stripped; if longer than limit, cut to it with three dots at the end."""
    whole = strip(F.coalesce(text, F.lit("")))
    cut = F.regexp_replace(F.substring(whole, 1, limit - 3), r"(?U)\s+$", "")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(cut, F.lit("...")))


def limit_output(text: Column, limit: int) -> Column:
    """Cut to limit - 1 characters and an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def next_output_limit(length: Column, limit: Column) -> Column:
    """200, 500, 1500: the next limit for an output that used up the last one, else null."""
    return F.when(length == limit, F.when(limit == 200, 500).when(limit == 500, 1500))


def version_of_namespace(namespace: Column) -> Column:
    return F.substring_index(F.coalesce(namespace, F.lit("")), ".", -1)


def display_api_name(api_id: Column) -> Column:
    """The last segment that says something: not numeric, and no short one with a digit.

    Cut at the first of '::', '.', ':' and '_' that occurs; all of it if every segment is passed over.
    """

    def last(separator: str) -> Column:
        parts = F.reverse(F.split(api_id, re.escape(separator)))
        telling = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^[0-9._-]+$") & ~((F.length(p) <= 4) & p.rlike("[0-9]")))
        return F.coalesce(F.get(telling, F.lit(0)), api_id)

    found = F.when(F.coalesce(api_id, F.lit("")) == "", F.lit(""))
    for separator in ("::", ".", ":", "_"):
        found = found.when(F.contains(api_id, F.lit(separator)), last(separator))
    return found.otherwise(api_id)


def normalized_api_name(name: Column) -> Column:
    """Up to the bracket, lower case, only letters, digits and underscores."""
    return F.regexp_replace(F.lower(F.substring_index(name, "(", 1)), "[^a-z0-9_]", "")


def chunk_id(namespace: Column, name: Column) -> Column:
    return F.concat(namespace, F.lit("."), normalized_api_name(name))


def title_api_name(name: Column, namespace: Column, title: Column) -> Column:
    """The title without its 'name namespace ' prefix."""
    prefix = F.concat(name, F.lit(" "), namespace, F.lit(" "))
    return strip(F.when(F.startswith(title, prefix), F.substring(title, F.length(prefix) + 1, F.length(title))).otherwise(F.coalesce(title, F.lit(""))))


def hit_key(prefix: str, collection: Column, api: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), collection, api)


def parse_hit_key(prefix: str, key: Column) -> Column:
    """struct(collection, api_id), null if the key is none of this prefix."""
    pattern = rf"^{re.escape(prefix)}:([^:]+):(.+)$"
    found = F.struct(F.regexp_extract(key, pattern, 1).alias("collection"), F.regexp_extract(key, pattern, 2).alias("api_id"))
    return F.when(key.rlike(pattern), found)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"[^0-9A-Za-z]+", "-")), "^-+|-+$", "")


def safe_id_fragment(document_id: Column) -> Column:
    """Up to 48 readable characters and 10 digits of the SHA-256."""
    readable = F.substring(F.regexp_replace(F.regexp_replace(document_id, "[^0-9A-Za-z._-]+", "_"), "^[._-]+|[._-]+$", ""), 1, 48)
    return F.concat(F.when(readable == "", "document").otherwise(readable), F.lit("-"), F.substring(sha256(document_id), 1, 10))


def safe_relative_path(path: Column) -> Column:
    """Whether a path is relative, not empty and without a step up."""
    return F.coalesce(path.rlike(r"^[^/\\]") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~path.rlike(r"^[A-Za-z]:"), F.lit(False))


def collection_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[a-z][a-z0-9_]{0,62}$") & ~F.startswith(name, F.lit("system.")), F.lit(False))


def duration(milliseconds: Column) -> Column:
    """Milliseconds for people: 850 ms, 12.3 s, 4 m 05 s."""
    seconds = milliseconds / 1000
    minutes = F.format_string("%d m %02d s", F.floor(seconds / 60), F.floor(seconds % 60))
    return F.when(milliseconds < 1000, F.format_string("%d ms", milliseconds.cast("long"))).when(seconds < 60, F.format_string("%.1f s", seconds)).otherwise(minutes)


def default_namespace_segment(segment: Column, known: dict[str, str]) -> Column:
    """A path segment as a namespace segment: the known name, else the slug, never empty."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), segment) if known else F.lit(None).cast("string")
    plain = F.regexp_replace(F.lower(segment), "[^a-z0-9]+", "_")
    return F.coalesce(named, F.when(F.regexp_replace(plain, "_", "") == "", "unknown").otherwise(F.regexp_replace(plain, "^_+|_+$", "")))


def namespace_of_path(path: Column, version: Column, below: str, prefix: str, known: dict[str, str] | None = None) -> Column:
    """prefix.segment, and the version if there is one, from the folder right under ``below``; null if there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, below)
    product = F.when((at > 0) & (at < F.size(parts)), F.get(parts, at.cast("int")))
    base = F.concat(F.lit(f"{prefix}."), default_namespace_segment(product, known or {}))
    return F.when(F.coalesce(version, F.lit("")) != "", F.concat(base, F.lit("."), version)).otherwise(base)


def authoritative_hints(given: dict[str, Column], path: Column, markdown: Column, source_url: Column, version_pattern: str, below: str, prefix: str, languages: dict[str, str] | None = None, categories: dict[str, str] | None = None, namespaces: dict[str, str] | None = None, known: dict[str, str] | None = None) -> Column:
    """struct(name, version, language, namespace, category, chunk_id) that rules give before a model is asked.

    What is given stands. Else the name is the first heading, the version what the pattern's group finds in the URL;
    folders of the path give language, namespace prefix and category; any other namespace follows from the path.
    """
    parts = F.split(path, "/")
    blank = F.lit(None).cast("string")
    of = lambda name: given.get(name, blank)
    by_folder = lambda table: F.coalesce(*[F.when(F.array_contains(parts, k), F.lit(v)) for k, v in (table or {}).items()], blank)
    name = F.coalesce(of("name"), F.nullif(F.trim(F.regexp_extract(markdown, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)), F.lit("")))
    version = F.coalesce(of("version"), F.nullif(F.regexp_extract(source_url, version_pattern, 1), F.lit("")))
    special = F.when(version.isNotNull(), F.concat(by_folder(namespaces), F.lit("."), version))
    namespace = F.coalesce(of("namespace"), special)
    whole = F.coalesce(namespace, namespace_of_path(path, version, below, prefix, known))
    chunk = F.coalesce(of("chunk_id"), F.when(normalized_api_name(name) != "", chunk_id(namespace, name)))
    return F.struct(name.alias("name"), version.alias("version"), F.coalesce(of("language"), by_folder(languages)).alias("language"), whole.alias("namespace"), F.coalesce(of("category"), by_folder(categories)).alias("category"), chunk.alias("chunk_id"))


# URLs


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed_uri(url: Column, hosts: list[str], prefixes: list[str], name_pattern: str) -> Column:
    """http(s), an allowed host, a path under an allowed prefix, and a file name of the pattern."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    under = F.lit(False)
    for p in prefixes:
        under = under | F.startswith(path, F.lit(p))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & host_of(url).isin([h.lower() for h in hosts]) & under & F.substring_index(path, "/", -1).rlike(name_pattern), F.lit(False))


def canonical_uri(url: Column) -> Column:
    """Lower-case scheme and host, the path as it is, no query and no fragment; for paths without percent escapes."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(.*)$", 1)
    return F.when(head != "", F.concat(F.lower(head), F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(.*)$", 2))).otherwise(bare)


@F.pandas_udf(T.StringType())
def canonical_uri_requoted(urls: pd.Series) -> pd.Series:
    """As canonical_uri, with percent escapes written in one way."""

    def one(url: str | None) -> str | None:
        if url is None:
            return None
        parts = urlsplit(url)
        path = quote(unquote(parts.path), safe="/:@-._~!$&'()*+,;=")
        return f"{parts.scheme.lower()}://{parts.netloc.lower()}{path}" if parts.netloc else path

    return urls.map(one)


@F.pandas_udf(T.StringType())
def resolve_uri(base: pd.Series, reference: pd.Series) -> pd.Series:
    """Absolute and data references as they are, others against the base."""
    return pd.Series([None if r is None else r if re.match(r"(?i)(https?:|data:)", r) else urljoin(b or "", r) for b, r in zip(base, reference, strict=True)])


def document_id_of(url: Column, prefixes: list[str]) -> Column:
    """The path below the longest allowed prefix, without suffix, '/' written '::'; null outside all of them."""
    path, found = F.url_decode(F.try_parse_url(url, F.lit("PATH"))), None
    for p in sorted(prefixes, key=len, reverse=True):
        below = F.regexp_replace(F.substring(path, len(p) + 1, F.length(path)), "^/+", "")
        value = F.regexp_replace(F.regexp_replace(below, r"\.[^./]+$", ""), "/", "::")
        found = F.when(F.startswith(path, F.lit(p)), value) if found is None else found.when(F.startswith(path, F.lit(p)), value)
    return found if found is not None else F.lit(None).cast("string")


def labelled_source_url(markdown: Column) -> Column:
    """The one http(s) URL behind a source label; null if there is none or they differ."""
    urls = F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"(?im)^>?\s*(?:来源|source|url)\s*[:：]\s*(https?://\S+)"), F.lit(1)))
    return F.when(F.size(urls) == 1, F.get(urls, F.lit(0)))


# What needs Unicode tables


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else t.casefold())


def semantic_text(markdown: Column) -> Column:
    """What is visible of a markdown text, without marks and white space, to compare versions of a page."""
    text = F.regexp_replace(nfc(markdown), r"(?m)^>\s*(来源|节点)\s*[:：].*$", "")
    text = F.regexp_replace(text, r"!\[([^\]]*)\]\([^)]+\)", "$1")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"[#>*_`|~\-\[\](){}]", ""), r"(?U)\s+", "")


def same_content(remote: Column, local: Column) -> Column:
    """Whether a page's visible text (20 characters at least) is all in the local one."""
    here, there = semantic_text(remote), semantic_text(local)
    return (F.length(here) >= 20) & F.contains(there, here)


def normalize_markdown(markdown: Column) -> Column:
    """NFC, line feeds, no trailing white space, at most two blank lines in a row, one line feed at the end."""
    text = F.regexp_replace(F.regexp_replace(nfc(markdown), "\r\n?", "\n"), r"(?m)[^\S\n]+$", "")
    return F.concat(strip(F.regexp_replace(text, r"\n{4,}", "\n\n\n")), F.lit("\n"))


def safe_path_component(title: Column) -> Column:
    """A title as one path component of at most 120 characters."""
    text = F.regexp_replace(strip(nfc(title)), r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", ""), 1, 120)
    return F.when(text == "", "_unknown_").otherwise(text)


def hierarchy_key(label: Column) -> Column:
    """A label for loose comparison: folded, without separators and brackets."""
    return F.regexp_replace(casefold(nfc(label)), r"(?U)[\s_\-（）()]+", "")
