"""Queries of publications: what a catalog leads to after several writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators.catalog import Conflict
from corvia.operators.publication import Catalog
from corvia.operators.validation import extraction_issues
from corvia.plans.registry import query, table
from corvia.sources.document_trees import register
from corvia.sources.ranged import RangedTable
from corvia.tables import new_folder


def _revisions(docs: DataFrame, number: int, status) -> tuple[DataFrame, DataFrame]:
    """Each document as a source, and one artifact of it."""
    own = docs.select(F.col("doc_id").cast("string").alias("d"), F.md5(F.col("text").cast("binary")).alias("content_hash"), status.alias("status"))
    own = own.withColumns({"wiki_id": F.lit("w"), "revision_number": F.lit(number)})
    ids = lambda kind: [F.concat(F.lit(f"{kind}:"), "d").alias(f"{kind}_id"), F.concat(F.lit(f"{kind}:"), "d", F.lit(f":{number}:"), "content_hash").alias(f"{kind}_revision_id")]
    return own.select(*ids("source"), "wiki_id", "revision_number", "content_hash"), own.select(*ids("artifact"), "wiki_id", "revision_number", "status", "content_hash")


@query("""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS h, lang, source, n_chars FROM documents),
moves AS (
  SELECT 1 AS version, 'source' AS kind, doc_id, 1 AS n, h FROM d WHERE lang IN ('en', 'de')
  UNION ALL SELECT 1, 'artifact', doc_id, 1, h FROM d WHERE lang IN ('en', 'de') AND n_chars % 7 <> 0
  UNION ALL SELECT 2, 'source', doc_id, 1, h FROM d WHERE lang NOT IN ('en', 'de')
  UNION ALL SELECT 2, 'artifact', doc_id, 1, h FROM d WHERE lang NOT IN ('en', 'de')
  UNION ALL SELECT 3, 'source', doc_id, 2, h FROM d WHERE source < 'src3'
  UNION ALL SELECT 3, 'artifact', doc_id, 2, h FROM d WHERE source < 'src3' AND n_chars % 3 <> 0
), seen AS (SELECT unnest([1, 2, 3]) AS seen_at)
SELECT seen_at AS at_version, kind, kind || ':' || doc_id AS id, kind || ':' || doc_id || ':' || n || ':' || h AS revision_id, version::BIGINT AS version
FROM seen JOIN moves ON version <= seen_at QUALIFY row_number() OVER (PARTITION BY seen_at, kind, doc_id ORDER BY version DESC) = 1
""")
def catalog_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers at each version of a catalog: a first commit, a writer who is late and stages again, rows that are given
    up, and second revisions of which some wait for review."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    catalog = Catalog(spark, new_folder(spark, "catalog"), "w")
    live, review = F.lit("active"), F.lit("pending_review")
    western = docs.where("lang IN ('en', 'de')")
    others = docs.where("lang NOT IN ('en', 'de')")
    first = catalog.stage("first", *_revisions(western, 1, F.when(F.col("n_chars") % 7 == 0, review).otherwise(live)))
    late = catalog.stage("late", *_revisions(others, 1, live))
    catalog.publish(first)
    try:
        catalog.publish(late)
        raise RuntimeError("two writers got the same version")
    except Conflict:
        catalog.abandon(late, "late")
        catalog.publish(catalog.stage("again", *_revisions(others, 1, live)))
    catalog.abandon(catalog.stage("given up", *_revisions(docs, 9, live)), "not wanted")
    catalog.publish(catalog.stage("second", *_revisions(docs.where("source < 'src3'"), 2, F.when(F.col("n_chars") % 3 == 0, review).otherwise(live))))
    found = [catalog.pointers(at).select(F.lit(at).alias("at_version"), "kind", "id", "revision_id", "version") for at in (1, 2, 3)]
    return found[0].union(found[1]).union(found[2])


@query("""
WITH d AS (SELECT coalesce(source, '') || chr(31) || doc_id AS key, source, md5(coalesce(text, '')) AS hash FROM documents)
SELECT key, CASE WHEN source = 'src3' THEN 'new' ELSE hash END AS hash FROM d WHERE source IS NULL OR source <> 'src5'
UNION ALL SELECT 'src3' || chr(31) || 'extra', 'new'
""")
def ranged_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of key ranges after one scope's rows were replaced, another's deleted, and a row came."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat_ws("\x1f", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("key"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"), "source")
    held = RangedTable(spark, new_folder(spark, "ranged"), "key string, hash string", "key", max(1, docs.count() // 40))
    held.upsert(rows.select("key", "hash"))
    held.replace("src3\x1f", "src3\x20", rows.where("source = 'src3'").select("key", F.lit("new").alias("hash")))
    held.upsert(rows.where("source = 'src5'").select("key", "hash"), F.lit(True))
    held.upsert(spark.createDataFrame([("src3\x1fextra", "new")], "key string, hash string"))
    return held.read()


@query("""
SELECT coalesce(source, 'none') || '/' || doc_id || '.md' AS path, strlen(text)::BIGINT AS length, md5(text) AS hash FROM documents
WHERE text IS NOT NULL AND strlen(text) BETWEEN 1000 AND 8000 AND source <> 'src1'
""")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of a tree, and those of some lengths and folders read back."""
    register(spark)
    folder = new_folder(spark, "tree")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select(path.alias("path"), "text").write.format("documents").option("path", folder).mode("append").save()
    found = spark.read.format("documents").option("path", folder).load().where("length >= 1000 AND length <= 8000 AND NOT path LIKE 'src1/%'")
    return found.select("path", "length", F.md5(F.col("text").cast("binary")).alias("hash"))


PLANTED = [
    [], ["ARTIFACT_SCOPE_MISMATCH"], ["EVIDENCE_NAMESPACE_MISMATCH"], ["EVIDENCE_VERSION_MISMATCH"], ["EVIDENCE_DOCUMENT_MISMATCH"], ["EVIDENCE_PART_NOT_FOUND"], ["EVIDENCE_CONTENT_HASH_MISMATCH"], ["EVIDENCE_QUOTE_NOT_FOUND", "EVIDENCE_RANGE_QUOTE_MISMATCH"],
    ["EVIDENCE_RANGE_OUT_OF_BOUNDS"], ["EVIDENCE_RANGE_QUOTE_MISMATCH"], ["RELATION_SCOPE_MISMATCH"], ["RELATION_EVIDENCE_NAMESPACE_MISMATCH"], ["RELATION_EVIDENCE_VERSION_MISMATCH"], ["RELATION_EVIDENCE_NOT_FOUND"], ["RELATION_EVIDENCE_INVALID"],
    ["RELATION_EVIDENCE_RANGE_QUOTE_MISMATCH"],
]
_PLANTED_SQL = " UNION ALL ".join(f"SELECT {k} AS k, '{code}' AS issue" for k, codes in enumerate(PLANTED) for code in codes)


@query(f"SELECT doc_id AS draft_id, issue FROM documents JOIN ({_PLANTED_SQL}) ON doc_id % 16 = k WHERE length(text) >= 60")
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a draft of each document: by its number, one thing or none."""
    docs = table(spark, sf_dir, "documents").where("length(text) >= 60")
    k = F.col("doc_id") % 16
    odd = lambda n, wrong, right: F.when(k == n, wrong).otherwise(right)
    source = lambda: F.coalesce(F.col("source"), F.lit("none"))

    def evidence(of: int) -> Column:
        """With the faults that begin at a number: namespace, version, document, then part and hash."""
        claim = of == 2
        return F.struct(
            odd(of + 2, F.lit("elsewhere"), F.col("doc_id").cast("string")).alias("document_id"), F.lit("c").alias("rag_collection_id"), odd(of, F.lit("elsewhere"), F.lit("")).alias("namespace"), odd(of + 1, F.lit("v9"), F.lit(None)).alias("version"),
            (odd(5, F.lit("p9"), F.lit("p1")) if claim else F.lit("p1")).alias("part_id"), odd(6 if claim else 14, F.lit("0"), F.sha2("text", 256)).alias("content_hash"),
            (odd(9, F.lit(5), F.lit(0)) if claim else odd(15, F.lit(5), F.lit(0))).alias("char_start"), (F.when(k == 8, F.length("text") + 5).when(k == 9, 6).otherwise(30) if claim else odd(15, F.lit(6), F.lit(30))).cast("int").alias("char_end"),
            (odd(7, F.lit("\x01none"), F.substring("text", 1, 20)) if claim else F.substring("text", 1, 20)).alias("quote_hint"),
        )

    relation = F.struct(F.lit("w").alias("target_wiki_id"), odd(10, F.lit("elsewhere"), source()).alias("target_namespace"), F.lit("v1").alias("target_version"), F.array(evidence(11)).alias("evidence"))
    draft = F.struct(F.lit("w").alias("wiki_id"), odd(1, F.lit("elsewhere"), source()).alias("namespace"), F.lit("v1").alias("version"), F.array(F.struct(F.lit("t").alias("text"), F.array(evidence(2)).alias("evidence"))).alias("claims"), F.array(relation).alias("related_artifacts"))
    own = F.col("doc_id").cast("string").alias("document_id")
    documents = docs.select(own, F.lit("w").alias("wiki_id"), F.lit("c").alias("rag_collection_id"), source().alias("namespace"), F.lit("v1").alias("version"), F.array(F.struct(F.lit("p1").alias("part_id"), F.col("text").alias("content"))).alias("parts"))
    return extraction_issues(docs.select(F.col("doc_id").alias("draft_id"), own, draft.alias("draft")), documents)
