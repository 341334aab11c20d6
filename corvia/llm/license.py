"""Licence scans: TF-IDF cosine of notices to templates, then inheritance by directory; DataFrame operations only.

A passage is a line of a file with a licence cue, a block of several wrapped lines with a cue (lines of at most
``WRAPPED`` characters, up to an empty or a longer one; a comment's empty lines don't end it) or, in a licence file, the
whole text. Passages and templates (``license_texts``: notices of
each licence's names, headers and whole texts) are sparse vectors of term frequency times inverse document frequency.
The collection whose documents count is that of all distinct passages and the templates, and every word's frequency is
counted, so a name that no template has weighs as much as one that a template has. A template speaks only of passages
that have all the words that tell its licence (its name and version); these passages are found first, and each distinct
one is scored once, by joining its words with those of the templates that speak of it. A file's own licence is that of the passage with the highest cosine, which has
to be ``COSINE`` at least; a whole text that reaches it comes before blocks, and a block before lines, as a part of one
licence may be the whole of another.

A licence file speaks for its directory. Every directory takes the licence of its nearest ancestor, itself included,
that has one: the distinct directories are joined to their ancestors' paths, files are joined to their directory. The
joins' right sides have one row per passage, word or directory; they are broadcast up to ``FEW`` rows and shuffled
beyond.

Defined results: null texts have no passage; a null path has no directory and inherits nothing; ties of cosine go to
the first template in order, ties within a directory to the smallest path; repeated rows stay; other columns are
carried along under any name, columns named like the results are replaced, and the text goes.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import durable
from corvia.llm.license_texts import FORMS, NAMES, TAGS, TEXTS

COSINE = 0.5
FEW = 10_000
#: Characters of a line up to which it may be one of a wrapped notice.
WRAPPED = 200
RESULTS = ["own_license", "cosine", "license", "inherited_from"]
WORD = r"[a-z0-9]+(?:[.-][0-9]+)*"
CUE = r"(?i)licen[sc]e|copyright|spdx|unencumbered|redistribut"
#: What begins a comment line, and an empty line.
COMMENT, EMPTY = r"^[ \t]*(?://|#|\*|/\*|--|;|%)", r"\n[ \t\r]*\n"
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice)(?:\.[a-z]+)?$"
#: Words of a licence's name that many have.
COMMON = {"the", "license", "licence", "version", "v", "international", "universal", "software"}


def words_in(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def templates() -> list[tuple[str, dict[str, int], set[str]]]:
    """(licence, words, words that a passage must have), in the order that breaks ties."""
    found = []
    for name, names in NAMES.items():
        for n in names:
            found += [(name, form.format(n), set(words_in(n)) - COMMON) for form in FORMS]
        for tag in [name, *TAGS.get(name, [])]:
            found.append((name, f"SPDX-License-Identifier: {tag}", set(words_in(tag)) - {"or", "later", "only"}))
    found += [(name, text, set(words_in(must))) for name, text, must in TEXTS]
    return [(name, dict(Counter(words_in(text))), must) for name, text, must in found]


def template_rows() -> list[tuple[int, str, str, int, bool]]:
    """(i, licence, word, count, must) of all templates."""
    return [(i, name, w, n, w in must) for i, (name, ws, must) in enumerate(templates()) for w, n in ws.items()]


def passages(text: Column, path: Column) -> Column:
    """The distinct passages of a file as (text, kind): 0 for a line, 1 for a block, 2 for the whole."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n", -1)
    marked = F.array_join(F.transform(lines, lambda x: F.when(F.length(x) <= WRAPPED, F.regexp_replace(x, COMMENT, ".")).otherwise("")), "\n")
    blocks = F.filter(F.split(marked, EMPTY, -1), lambda x: F.contains(x, F.lit("\n")) & x.rlike(CUE))
    kind = lambda found, k: F.transform(found, lambda x: F.struct(x.alias("text"), F.lit(k).alias("kind")))
    none = F.array().cast("array<struct<text:string,kind:int>>")
    whole = F.when(F.coalesce(path.rlike(LICENSE_FILE), F.lit(False)) & (F.length(text) > 0), kind(F.array(text), 2)).otherwise(none)
    cued = F.when(text.rlike(CUE), F.concat(kind(F.filter(lines, lambda x: x.rlike(CUE)), 0), kind(blocks, 1))).otherwise(none)
    return F.array_distinct(F.concat(cued, whole))


def verdicts(texts: DataFrame) -> DataFrame:
    """(key, license, cosine) of distinct passages (key, text): the nearest template of those that speak of it, if any."""
    spark = texts.sparkSession
    rows = F.broadcast(spark.createDataFrame(template_rows(), "i int, name string, word string, tf long, must boolean"))  # a fixed table
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    distinct = texts.select("key", F.array_distinct(words).alias("words"))
    needed = F.array(*[F.lit(w) for w in sorted({w for _, _, must in templates() for w in must})])
    held = distinct.select("key", F.explode(F.array_intersect("words", needed)).alias("word")).join(rows.where("must").select("i", "name", "word"), "word")
    musts = rows.where("must").groupBy("i").agg(F.count(F.lit(1)).alias("musts"))
    spoken = held.groupBy("key", "i", "name").agg(F.count(F.lit(1)).alias("found")).join(F.broadcast(musts), "i").where("found = musts").select("key", "i", "name")
    spoken = durable(spoken)
    used = distinct.select(F.explode("words").alias("word")).unionAll(rows.select("word"))
    n = texts.count() + len(templates())
    idf = durable(used.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.log1p(F.lit(float(n)) / F.col("df")).alias("idf")))
    hint = F.broadcast if idf.count() <= FEW else lambda df: df
    counted = texts.join(spoken.select("key").distinct(), "key", "left_semi").select("key", F.explode(words).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    weighed = durable(counted.join(hint(idf), "word").select("key", "word", (F.col("n") * F.col("idf")).alias("x")))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    own = rows.join(idf, "word").withColumn("y", F.col("tf") * F.col("idf"))
    lengths = own.groupBy("i").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    own = durable(own.join(F.broadcast(lengths), "i").select("i", "word", (F.col("y") / F.col("length")).alias("y")))
    known = weighed.join(F.broadcast(own.select("word").distinct()), "word", "left_semi")
    dots = known.join(spoken, "key").join(F.broadcast(own), ["i", "word"]).groupBy("key", "i", "name").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    dots = dots.join(norms, "key").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    best = F.max(F.struct("cosine", (-F.col("i")).alias("i"), "name")).alias("b")
    return dots.groupBy("key").agg(best).select("key", F.col("b.name").alias("license"), F.col("b.cosine").alias("cosine"))


def own_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", least: float = COSINE) -> DataFrame:
    """Every file without its text, with own_license (null if none) and cosine (null without a passage)."""
    carried = [c for c in files.columns if c not in (text_col, "own_license", "cosine")]
    marked = files.select(F.struct(*carried).alias("_row"), passages(F.col(text_col), F.col(path_col)).alias("_p"))
    marked = durable(marked.withColumn("_id", F.monotonically_increasing_id()))
    each = marked.where(F.size("_p") > 0).select("_id", F.explode("_p").alias("p")).select("_id", "p.*").withColumn("key", F.md5(F.col("text").cast("binary")))
    found = durable(verdicts(durable(each.select("key", "text").distinct())))
    few = found.count() <= FEW
    judged = each.select("_id", "key", "kind").join(F.broadcast(found) if few else found, "key", "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    reached = F.col("cosine") >= least
    best = judged.groupBy("_id").agg(F.max(F.struct(reached.alias("ok"), F.when(reached, F.col("kind")).alias("kind"), "cosine", "license")).alias("_b"))
    joined = marked.join(best, "_id", "left")
    return joined.select("_row.*", F.when(F.col("_b.ok"), F.col("_b.license")).alias("own_license"), F.col("_b.cosine").alias("cosine"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add license (own, or of the nearest ancestor directory) and inherited_from (that directory, null if own)."""
    carried = [c for c in files.columns if c not in ("license", "inherited_from")]
    found = files.select(F.struct(*carried).alias("_row"), directory(F.col(path_col)).alias("_dir"), F.col(path_col).alias("_path"), F.col("own_license").alias("_own"))
    speaks = F.col("_path").rlike(LICENSE_FILE) & F.col("_own").isNotNull()
    declared = durable(found.where(speaks).groupBy("_dir").agg(F.min(F.struct("_path", "_own"))["_own"].alias("_license")))
    few = declared.count() <= FEW
    parts = F.split("_dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("up"), n.alias("depth")))
    ancestors = found.where(F.col("_path").isNotNull()).select("_dir").distinct().select("_dir", F.explode(up).alias("a")).select("_dir", "a.*")
    says = declared.withColumnRenamed("_dir", "up")
    above = ancestors.join(F.broadcast(says) if few else says, "up")
    nearest = durable(above.groupBy("_dir").agg(F.max_by(F.struct("up", "_license"), "depth").alias("_near")))
    joined = found.join(F.broadcast(nearest) if nearest.count() <= FEW else nearest, "_dir", "left")
    return joined.select("_row.*", F.coalesce("_own", "_near._license").alias("license"), F.when(F.col("_own").isNull(), F.col("_near.up")).alias("inherited_from"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Every file with own_license, cosine, license and inherited_from; the text goes."""
    return inherit(durable(own_licenses(files.drop(*[c for c in RESULTS if c != path_col]), path_col, text_col)), path_col)


def document_path(doc_id: Column, source: Column) -> Column:
    """A stand-in for documents, which have no path: source/block/node/id.txt, and one in ten source/block/LICENSE."""
    block, turn = F.floor(doc_id / 2000).cast("string"), F.floor(doc_id / 20) % 10
    name = F.when(turn == 3, F.lit("LICENSE")).otherwise(F.concat(F.lit("n"), F.floor(doc_id / 200).cast("string"), F.lit("/"), doc_id.cast("string"), F.lit(".txt")))
    return F.concat(F.coalesce(source, F.lit("unknown")), F.lit("/"), block, F.lit("/"), name)


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", document_path(F.col("doc_id"), F.col("source")).alias("path"), "text"))
    return found.select("doc_id", "path", "own_license", F.round("cosine", 6).alias("cosine"), "license", "inherited_from")


def oracle() -> str:
    rows = ", ".join(f"({i}, '{name}', '{w}', {n}, {must})" for i, name, w, n, must in template_rows())
    return rf"""
WITH t(i, name, w, tf, must) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(source, 'unknown') || '/' || (doc_id // 2000)::VARCHAR || CASE WHEN doc_id // 20 % 10 = 3 THEN '/LICENSE' ELSE '/n' || (doc_id // 200)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' END AS path
  FROM documents
), cued AS (
  SELECT r, string_split(text, chr(10)) AS lines FROM d WHERE regexp_matches(text, '{CUE}')
), blocks AS (
  SELECT r, unnest(string_split_regex(array_to_string(list_transform(lines, lambda x: CASE WHEN length(x) <= {WRAPPED} THEN regexp_replace(x, '{COMMENT}', '.') ELSE '' END), chr(10)), '{EMPTY}')) AS p FROM cued
), p AS (
  SELECT r, p, 0 AS kind FROM (SELECT r, unnest(lines) AS p FROM cued) WHERE regexp_matches(p, '{CUE}')
  UNION SELECT r, p, 1 FROM blocks WHERE contains(p, chr(10)) AND regexp_matches(p, '{CUE}')
  UNION SELECT r, text, 2 FROM d WHERE path LIKE '%/LICENSE' AND text <> ''
), distinct_p AS (SELECT DISTINCT p FROM p
), pw AS (
  SELECT p, w, count(*) AS n FROM (SELECT p, unnest(regexp_extract_all(lower(p), '{WORD}')) AS w FROM distinct_p) GROUP BY p, w
), idf AS (
  SELECT w, ln(1 + ((SELECT count(*) FROM distinct_p) + {len(templates())})::DOUBLE / count(*)) AS idf
  FROM (SELECT w FROM pw UNION ALL SELECT w FROM t) GROUP BY w
), tw AS (
  SELECT i, name, w, must, sum(must::INT) OVER (PARTITION BY i) AS musts, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY i)) AS y FROM t JOIN idf USING (w)
), px AS (SELECT p, w, n * idf AS x FROM pw JOIN idf USING (w)
), norm AS (SELECT p, sqrt(sum(x * x)) AS norm FROM px GROUP BY p
), dots AS (
  SELECT p, i, any_value(name) AS name, sum(x * y) AS dot FROM px JOIN tw USING (w) GROUP BY p, i HAVING sum(must::INT) = any_value(musts)
), verdict AS (
  SELECT p, arg_max(name, (cosine, -i)) AS name, max(cosine) AS cosine FROM (SELECT p, i, name, round(dot / norm, 9) AS cosine FROM dots JOIN norm USING (p)) GROUP BY p
), best AS (
  SELECT r, max(struct_pack(ok := cosine >= {COSINE}, kind := CASE WHEN cosine >= {COSINE} THEN kind ELSE -1 END, cosine := cosine, name := coalesce(name, ''))) AS b
  FROM (SELECT r, kind, coalesce(cosine, 0.0) AS cosine, name FROM p LEFT JOIN verdict USING (p)) GROUP BY r
), own AS (
  SELECT d.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, CASE WHEN b.ok THEN b.name END AS own_license, b.cosine AS cosine
  FROM d LEFT JOIN best USING (r)
), declared AS (
  SELECT dir AS up, arg_min(own_license, (path, own_license)) AS l FROM own WHERE path LIKE '%/LICENSE' AND own_license IS NOT NULL GROUP BY dir
), nearest AS (
  SELECT o.dir, arg_max(up, length(up)) AS up, arg_max(l, length(up)) AS l
  FROM (SELECT DISTINCT dir FROM own) o JOIN declared ON o.dir = up OR starts_with(o.dir, up || '/') GROUP BY o.dir
)
SELECT doc_id, path, own_license, round(cosine, 6) AS cosine, coalesce(own_license, l) AS license, CASE WHEN own_license IS NULL THEN up END AS inherited_from
FROM own LEFT JOIN nearest USING (dir)
"""
