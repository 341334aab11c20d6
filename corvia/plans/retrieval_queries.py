"""Queries of scopes, recall channels, fusion and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators import capsule as capsules
from corvia.operators import fallback
from corvia.operators import retrieval as r
from corvia.operators import scope as scopes
from corvia.operators.catalog import cache_misses
from corvia.operators.frequencies import Frequencies
from corvia.operators.postings import Postings
from corvia.operators.ranking import top_per
from corvia.operators.vector_index import VectorIndex, recall
from corvia.plans.registry import query, table
from corvia.tables import durable, new_folder

WORD = r"[\p{L}\p{N}_]+"

# The sparse vectors of documents and of the queries in benchmark, as common table expressions.
SPARSE = rf"""
tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM tokens GROUP BY token),
weighed AS (
  SELECT token, df, ('0x' || substr(md5(token), 1, 6))::INT AS token_id, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / df) AS idf FROM df
),
doc_vectors AS (
  SELECT doc_id, token_id, max(tf * idf) AS w FROM (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY doc_id, token) JOIN weighed USING (token) GROUP BY doc_id, token_id
),
query_vectors AS (
  SELECT item_id, token_id, max(tf * idf) AS w
  FROM (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM benchmark) GROUP BY item_id, token)
  JOIN weighed USING (token) GROUP BY item_id, token_id
),
sparse AS (
  SELECT item_id AS query_id, doc_id AS id, sum(q.w * d.w) AS score FROM query_vectors q JOIN doc_vectors d USING (token_id) GROUP BY item_id, doc_id
)"""


@query("""SELECT doc_id, source AS namespace, lang AS language FROM documents WHERE source = 'src3' AND lang = 'en'""")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("namespace"), F.col("lang").alias("language"), F.lit("v1").alias("version"), F.lit(False).alias("deprecated"))
    return docs.where(scopes.document_filter("src3", "v1", "en")).select("doc_id", "namespace", "language")


@query("""
WITH i AS (
  SELECT doc_id, source, lang, CASE WHEN lang = 'en' THEN 'source' ELSE 'concept' END AS kind,
         CASE WHEN n_chars > 5000 THEN 'stale' WHEN n_chars < 300 THEN 'archived' ELSE 'active' END AS status FROM documents
), j AS (
  SELECT *, source = 'src3' AND (kind <> 'source' OR lang = 'en') AND status = 'active' AS inside,
         CASE WHEN source <> 'src3' THEN 0 ELSE 1 END + CASE WHEN lang = 'de' THEN 0 ELSE 1 END AS n_prov,
         CASE WHEN lang = 'fr' OR source <> 'src3' THEN 0 ELSE 1 END AS n_rel FROM i
)
SELECT doc_id, inside AND n_prov > 0 AS kept,
       concat_ws(',', CASE WHEN NOT inside THEN 'OUT_OF_SCOPE_RESULT_DROPPED' END, CASE WHEN inside AND n_prov < 2 THEN 'OUT_OF_SCOPE_PROVENANCE_DROPPED' END,
                 CASE WHEN inside AND n_rel < 1 THEN 'OUT_OF_SCOPE_RELATION_DROPPED' END, CASE WHEN inside AND n_prov = 0 THEN 'KNOWLEDGE_WITHOUT_PROVENANCE_DROPPED' END) AS warnings,
       n_prov::INT AS n_provenance, n_rel::INT AS n_relations
FROM j
""")
def filter_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = lambda ns, c: F.struct(F.lit("w").alias("wiki_id"), ns.alias("namespace"), F.lit("v1").alias("version"), F.lit(c).alias("rag_collection_id"))
    status = F.when(F.col("n_chars") > 5000, "stale").when(F.col("n_chars") < 300, "archived").otherwise("active")
    item = F.struct(
        F.lit("w").alias("wiki_id"), F.col("source").alias("namespace"), F.lit("v1").alias("version"), F.when(F.col("lang") == "en", "source").otherwise("concept").alias("kind"),
        F.col("lang").alias("language"), status.alias("status"), F.array(F.lit("c1"), F.lit("c2")).alias("rag_collection_ids"),
        F.array(evidence(F.col("source"), "c1"), evidence(F.when(F.col("lang") == "de", "other").otherwise(""), "c2")).alias("provenance"),
        F.array(F.struct(F.lit("w").alias("target_wiki_id"), F.when(F.col("lang") == "fr", "other").otherwise(F.col("source")).alias("target_namespace"), F.lit("v1").alias("target_version"))).alias("relationships"),
    )
    hits = table(spark, sf_dir, "documents").select("doc_id", item.alias("item"))
    found = scopes.filter_result(hits, scopes.Scope("w", "src3", "v1", "en"))
    return found.select("doc_id", "kept", F.array_join("warnings", ",").alias("warnings"), F.size("item.provenance").alias("n_provenance"), F.size("item.relationships").alias("n_relations"))


@query("""
WITH asked AS (SELECT n_nationkey AS query_id, CASE WHEN n_nationkey < 20 THEN 'Brand#' || n_nationkey ELSE 'ECONOMY' END AS t FROM nation),
by_name AS (SELECT query_id, p_partkey AS id FROM asked JOIN part ON p_type = t),
by_id AS (SELECT query_id, p_partkey AS id FROM asked JOIN part ON p_brand = t WHERE query_id NOT IN (SELECT query_id FROM by_name))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id)::INT AS rank FROM (SELECT * FROM by_name UNION ALL SELECT * FROM by_id) QUALIFY rank <= 20
""")
def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_nationkey") < 20, F.concat(F.lit("Brand#"), "n_nationkey")).otherwise("ECONOMY")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), text.alias("text"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"), F.col("p_brand").alias("api_id"))
    return r.exact_names(names, docs)


@query("""
SELECT p_partkey, ((contains(lower(p_name), 'ring'))::INT + (contains(lower(p_brand), 'ring'))::INT + (contains(lower(p_type || ' ' || p_name), 'ring'))::INT) AS score FROM part WHERE score > 0
""")
def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = r.lexical_score(" Ring ", F.col("p_name"), F.array("p_brand"), F.concat_ws(" ", "p_type", "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).where("score > 0")


@query(rf"""
SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS token FROM documents) GROUP BY token
""")
def tokenize_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.document_frequency(table(spark, sf_dir, "documents"), F.col("text"))


@query(f"WITH {SPARSE} SELECT doc_id, token_id, round(w, 8) AS weight FROM doc_vectors")
def sparse_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = r.sparse_vectors(docs, "doc_id", F.col("text"), r.document_frequency(docs, F.col("text")), docs.count())
    return found.select("doc_id", "token_id", F.round("weight", 8).alias("weight"))


@query(f"""
WITH {SPARSE} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sparse QUALIFY rank <= 10
""")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return r.sparse_top_k(table(spark, sf_dir, "documents"), queries, 10).withColumn("score", F.round("score", 6))


@query(f"""
WITH {SPARSE} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sparse QUALIFY rank <= 10
""")
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through an inverted index, which is built from the documents."""
    queries, docs = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, sf_dir, "documents")
    index = Postings(spark, new_folder(spark, "postings")).build(docs, durable(r.document_frequency(docs, F.col("text"))), docs.count())
    return index.search(queries, 10)[0].withColumn("score", F.round("score", 6))


@query(rf"""
WITH now AS (SELECT doc_id, text FROM documents WHERE source <> 'src1' AND source <> 'src2' UNION ALL SELECT doc_id, 'changed ' || text FROM documents WHERE source = 'src2')
SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS token FROM now) GROUP BY token
UNION ALL SELECT '', count(*) FROM now
""")
def frequency_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies after documents came, went and changed; the row without a token counts documents."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    kept = Frequencies(spark, new_folder(spark, "frequencies"))
    kept.update(docs.where("lang = 'en'"))
    kept.update(docs.where("lang IS NULL OR lang <> 'en'"))
    kept.update(removed=docs.where("source = 'src1'"))
    changed = docs.where("source = 'src2'")
    kept.update(changed.withColumn("text", F.concat(F.lit("changed "), "text")), changed)
    df, n = kept.current()
    return df.union(spark.createDataFrame([("", n)], "token string, df long"))


COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"


@query(f"""
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, id)::INT AS rank
FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {COSINE} AS score FROM embeddings c, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE c.label = q.label) QUALIFY rank <= 10
""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector within the scope of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.orderBy("vec_id").limit(1)
    label = one.first()["label"]
    found = r.dense_top_k(vectors.where(F.col("label") == label), one.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)
    return found.withColumn("score", F.round("score", 6))


@query(f"""
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank
FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {COSINE} AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10
""")
def batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for every vector whose id is divisible by 50, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return r.dense_top_k(vectors, queries, 10).withColumn("score", F.round("score", 6))


@query(rf"""
WITH q AS (SELECT item_id AS query_id, text, 'src' || (item_id % 10) AS namespace, CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language FROM benchmark),
s AS (SELECT DISTINCT namespace, language FROM q),
held AS (SELECT s.namespace, s.language, doc_id, text FROM documents d JOIN s ON d.source = s.namespace AND (s.language IS NULL OR d.lang = s.language)),
size AS (SELECT namespace, coalesce(language, '') AS language, count(*) AS n FROM held GROUP BY ALL),
tf AS (SELECT namespace, coalesce(language, '') AS language, doc_id, token, count(*) AS tf FROM (SELECT namespace, language, doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM held) GROUP BY ALL),
idf AS (SELECT namespace, language, token, ('0x' || substr(md5(token), 1, 6))::INT AS token_id, ln(1 + any_value(n)::DOUBLE / count(*)) AS idf FROM tf JOIN size USING (namespace, language) GROUP BY namespace, language, token),
dv AS (SELECT namespace, language, doc_id, token_id, max(tf * idf) AS w FROM tf JOIN idf USING (namespace, language, token) GROUP BY ALL),
qt AS (SELECT query_id, namespace, coalesce(language, '') AS language, token, count(*) AS tf FROM (SELECT query_id, namespace, language, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM q) GROUP BY ALL),
qv AS (SELECT query_id, namespace, language, token_id, max(tf * idf) AS w FROM qt JOIN idf USING (namespace, language, token) GROUP BY ALL),
sc AS (SELECT query_id, doc_id AS id, sum(qv.w * dv.w) AS score FROM qv JOIN dv USING (namespace, language, token_id) GROUP BY query_id, doc_id)
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sc QUALIFY rank <= 5
""")
def batch_of_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that each have a scope of their own, answered in one plan."""
    from corvia.plans import knowledge

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("-").alias("name"), F.lit("-").alias("api_id"), "text", F.col("source").alias("namespace"), F.lit("v1").alias("version"), F.col("lang").alias("language"), F.lit(False).alias("deprecated"))
    language = F.when(F.col("item_id") % 3 == 0, "en").when(F.col("item_id") % 3 == 1, "de")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), F.col("item_id") % 10).alias("namespace"), F.lit("v1").alias("version"), language.alias("language"))
    return knowledge.query_batch(docs, asked, 5)[0].select("query_id", "id", F.round("score", 6).alias("score"), "rank")


SCOPED = f"""
SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank
FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, {COSINE} AS score FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0) QUALIFY rank <= 10
"""


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, VectorIndex]:
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, new_folder(spark, "vectors")).build(vectors, scope=F.col("label"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("scope"), F.col("embedding").alias("vector"))
    return vectors, queries, index


@query(SCOPED)
def ann_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best vectors within each query's label, through the index and its bounds."""
    vectors, queries, index = _scoped(spark, sf_dir)
    return index.search(vectors, queries, 10, exact=True).withColumn("score", F.round("score", 6))


@query(f"SELECT count(DISTINCT query_id) AS queries, count(*) AS wanted, true AS reached FROM ({SCOPED})")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the approximate search, with lists tuned on other queries, finds nine of ten of the rows that an exact one gives."""
    vectors, queries, index = _scoped(spark, sf_dir)
    found = index.search(vectors, queries, 10, probes=index.tuned(vectors, 10, scope=F.col("label")))
    wanted = durable(index.search(vectors, queries, 10, exact=True))
    share = recall(found, wanted)
    return wanted.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.lit(share >= 0.9).alias("reached"))



@query("""
WITH lists AS (
  SELECT 0 AS list, doc_id AS id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 100
  UNION ALL
  SELECT 1, doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY len(string_split(text, ' ')) DESC, doc_id) AS rank FROM documents) WHERE rank <= 100
)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, arg_min(list, (list, rank))::INT AS first_list, arg_min(rank, (list, rank))::INT AS first_rank FROM lists GROUP BY id
""")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.lit(0).alias("query_id"))
    lists = [top_per(docs, ["query_id"], 100, [F.desc(c), F.col("doc_id")]).select("query_id", F.lit(i).alias("list"), F.col("doc_id").alias("id"), "rank") for i, c in enumerate(("n_chars", "n_words"))]
    return r.rrf(lists[0].union(lists[1])).select("id", F.round("score", 12).alias("score"), "first_list", "first_rank")


FUSED = """
WITH hits AS (
  SELECT 'source' AS kind, doc_id AS id, lang, source, 'exact' AS channel, NULL AS ranking, NULL AS raw, n AS ord FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 50
  UNION ALL SELECT 'source', doc_id, lang, source, 'dense', 'artifact:dense', NULL, 100 + n FROM (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS n FROM documents) WHERE n <= 50
  UNION ALL SELECT 'source', doc_id, lang, source, 'graph', NULL, n_chars / 10000.0::DOUBLE, 200 + n FROM (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS n FROM documents) WHERE n <= 50
), each AS (
  SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY coalesce(ranking, channel) ORDER BY ord)) + CASE channel WHEN 'exact' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
            + CASE WHEN channel = 'graph' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)) * 0.02::DOUBLE ELSE 0.0::DOUBLE END AS x,
         CASE lang WHEN 'en' THEN 0.02::DOUBLE WHEN 'de' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN source <> 'src1' THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS once FROM hits
), fused AS (
  SELECT kind, id, round(sum(x) + arg_min(once, ord), 8) AS score, string_agg(DISTINCT channel, ',' ORDER BY channel) AS signals FROM each GROUP BY kind, id
)
SELECT kind, id, score, signals, CASE WHEN contains(signals, 'exact') THEN 'strong' WHEN contains(signals, ',') THEN 'moderate' ELSE 'weak' END AS match_confidence,
       row_number() OVER (ORDER BY score DESC, kind, id)::INT AS rank FROM fused QUALIFY rank <= 20
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.lit(0).alias("query_id"))
    parts = []
    for i, (channel, ranking, order) in enumerate((("exact", None, [F.desc("n_chars")]), ("dense", "artifact:dense", [F.col("n_chars")]), ("graph", None, [F.col("source")]))):
        some = top_per(docs, ["query_id"], 50, [*order, F.col("doc_id")])
        raw = F.col("n_chars") / 10000.0 if channel == "graph" else F.lit(None).cast("double")
        confidence = F.when(F.col("lang") == "en", "high").when(F.col("lang") == "de", "medium").otherwise("low")
        parts.append(some.select("query_id", F.lit("source").alias("kind"), F.col("doc_id").alias("id"), F.lit(channel).alias("channel"), F.lit(ranking).cast("string").alias("ranking"), raw.alias("raw_score"), (F.lit(100 * i) + F.col("rank")).alias("ord"), confidence.alias("confidence"), F.when(F.col("source") != "src1", "active").otherwise("stale").alias("status")))
    return parts[0].union(parts[1]).union(parts[2])


@query(FUSED)
def fuse_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.top_ranked(r.fuse_hits(_hits(spark, sf_dir)), 20)
    return found.select("kind", "id", "score", F.array_join("rank_signals", ",").alias("signals"), "match_confidence", "rank")


@query()
def capsule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused hits packed into a small budget; the size is that of JSON text, which SQL can't give."""
    ranked = r.top_ranked(r.fuse_hits(_hits(spark, sf_dir)), 20)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("namespace"), F.col("text").alias("summary"))
    return capsules.build_capsules(ranked.join(docs, "id").drop("ord"), "small")


@query("""
WITH s AS (
  SELECT doc_id, source, '[' || doc_id || ']' || chr(10) || text AS section FROM documents
), u AS (
  SELECT *, 12000 - coalesce(sum(length(section) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM s
)
SELECT doc_id, source, md5(substr(section, 1, room::INT)) AS packed_md5, least(length(section), room)::INT AS n FROM u WHERE room > 0
""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("["), "doc_id", F.lit("]\n"), "text").alias("section"))
    packed = capsules.context_pack(docs, 12000, ["source"], [F.col("doc_id")])
    return packed.select("doc_id", "source", F.md5(F.col("packed").cast("binary")).alias("packed_md5"), F.length("packed").alias("n"))


@query("""
SELECT source AS rag_collection_id, doc_id::VARCHAR AS document_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def cache_miss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rag_collection_id"), F.col("doc_id").cast("string").alias("document_id"))
    wiki = docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return cache_misses(docs, wiki.select(F.array(F.struct("rag_collection_id", "document_id")).alias("provenance")))


@query(rf"""
WITH {SPARSE},
asked AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))) AS token FROM benchmark),
held AS (SELECT DISTINCT doc_id, token FROM tokens),
lexical AS (
  SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM asked JOIN held USING (token) GROUP BY item_id, doc_id QUALIFY rank <= 50
),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sparse QUALIFY rank <= 50),
lists AS (SELECT query_id, 0 AS list, id, rank FROM lexical UNION ALL SELECT query_id, 1, id, rank FROM dense),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS first_seen FROM lists GROUP BY query_id, id)
SELECT query_id, id, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_seen)::INT AS rank FROM fused QUALIFY rank <= 10
""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and sparse channels over all documents, fused by reciprocal rank, for every text of benchmark."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return r.hybrid_search(table(spark, sf_dir, "documents"), queries, 10)


# Documents as API documents with vectors of the table embeddings; benchmark items ask with the vector of their id.
SOURCE_SEARCH = rf"""
{SPARSE},
asked AS (SELECT item_id AS query_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
exact AS (
  SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM benchmark JOIN documents ON 'd' || doc_id = split_part(benchmark.text, ' ', 1) AND regexp_matches(benchmark.text, '^[A-Za-z_][A-Za-z0-9_.:#]*$') QUALIFY rank <= 20
),
dense_scores AS (
  SELECT query_id, vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM asked q, embeddings c WHERE vec_id IN (SELECT doc_id FROM documents)
),
dense AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM dense_scores QUALIFY rank <= 20),
sparse_list AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sparse QUALIFY rank <= 20),
lists AS (SELECT query_id, 0 AS list, id, rank FROM exact UNION ALL SELECT query_id, 1, id, rank FROM dense UNION ALL SELECT query_id, 2, id, rank FROM sparse_list),
fused AS (
  SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list, rank)) AS first_seen,
         CASE WHEN bool_or(list = 0) THEN 'exact' WHEN bool_or(list = 2) THEN 'sparse' ELSE 'dense' END AS channel FROM lists GROUP BY query_id, id
),
found AS (
  SELECT query_id, id, round(score, 8) AS score, channel, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first_seen)::INT AS rank FROM fused QUALIFY rank <= 20
)"""


def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as rows of a vector table."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dense_embedding")), "doc_id", "left")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("name"), F.concat(F.lit("api:"), "doc_id").alias("api_id"), *none("api_name", "parameters_md", "returns_json"), F.col("lang").alias("language"), F.concat(F.lit("about "), "source").alias("description"), F.concat(F.lit("d"), "doc_id", F.lit("()")).alias("signature"), F.array("source", "lang").alias("examples"), F.when(F.col("lang") == "en", F.concat(F.lit("# d"), "doc_id")).otherwise("").alias("source_markdown"), "text", "dense_embedding")


def _source_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    queries = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left").select(F.col("item_id").alias("query_id"), "text", "vector")
    return r.source_search(api_documents(spark, sf_dir), queries, 20)


@query(f"WITH {SOURCE_SEARCH} SELECT * FROM found")
def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, dense and sparse channels of all documents, fused by reciprocal rank, for every item of benchmark."""
    return _source_found(spark, sf_dir)


FALLBACK = rf"""
{SOURCE_SEARCH},
hits AS (
  SELECT query_id, 'api:' || id AS document_id, 'd' || id AS title, channel, score, rank, 'source:docs:api:' || id AS item,
         CASE WHEN lang = 'en' THEN '# d' || id ELSE 'd' || id || '()' || chr(10) || 'about ' || source || chr(10) || source || chr(10) || lang END AS content
  FROM found JOIN documents ON doc_id = id
),
cited AS (SELECT DISTINCT 'api:' || doc_id AS document_id FROM labels WHERE quality = 1),
ranked_in AS (
  SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id, channel ORDER BY rank)) + CASE channel WHEN 'exact' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + 0.03::DOUBLE AS s FROM hits
),
first_pass AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, lower(title), item) AS n FROM ranked_in
),
wiki AS (
  SELECT item_id AS query_id, 'concept:' || (item_id % 7) AS item, 'weak ' || (item_id % 7) AS title FROM benchmark WHERE item_id % 2 = 0
),
entered AS (
  SELECT query_id, 'concept' AS kind, item, title, 'lexical' AS channel, 1 AS ord, 0.0::DOUBLE AS once FROM wiki
  UNION ALL SELECT query_id, 'source', item, title, channel, 1000000 + n, 0.03::DOUBLE FROM first_pass
),
scored AS (
  SELECT *, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id, channel ORDER BY ord)) + CASE channel WHEN 'exact' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + once AS s FROM entered
)"""


def _fallback(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Source hits, and a weak item of the wiki for every other query."""
    hits = fallback.source_hits(_source_found(spark, sf_dir), api_documents(spark, sf_dir), "n", "v1", "docs")
    number = F.col("item_id") % 7
    evidence = F.array().cast("array<struct<rag_collection_id:string,document_id:string>>")
    wiki = table(spark, sf_dir, "benchmark").where("item_id % 2 = 0").select(
        F.col("item_id").alias("query_id"), F.lit("concept").alias("kind"), F.concat(F.lit("concept:"), number).alias("id"), F.lit("w").alias("wiki_id"), F.lit("n").alias("namespace"), F.lit("v1").alias("version"), F.concat(F.lit("weak "), number).alias("title"), F.lit("").alias("summary"),
        F.lit("low").alias("confidence"), F.lit("stale").alias("status"), F.lit(0.016).alias("score"), F.array(F.lit("lexical")).alias("rank_signals"), F.lit("weak").alias("match_confidence"), F.lit(1).alias("rank"), evidence.alias("provenance"),
    )
    return hits, wiki


@query(f"""
WITH {FALLBACK}
SELECT query_id, kind, item AS id, round(s, 8) AS score, CASE channel WHEN 'exact' THEN 'strong' ELSE 'weak' END AS match_confidence,
       row_number() OVER (PARTITION BY query_id ORDER BY round(s, 8) DESC, kind, 'n', 'v1', lower(title), item)::INT AS rank FROM scored QUALIFY rank <= 10
""")
def retrieval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources fused with the wiki's weak items, for every item of benchmark."""
    hits, wiki = _fallback(spark, sf_dir)
    sources = fallback.ranked_sources(fallback.source_items(hits, "w"), 10)
    return fallback.merged(wiki, sources, 10).select("query_id", "kind", "id", "score", "match_confidence", "rank")


@query(f"""
WITH {FALLBACK}
SELECT query_id, 'docs' AS rag_collection_id, document_id, 'w' AS wiki_id, md5(content) AS content_md5, 'RAG fallback returned a source without a valid Wiki artifact' AS reason
FROM hits WHERE document_id NOT IN (SELECT document_id FROM cited)
""")
def enrichment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents of the source hits no item of the wiki cites; labels of quality 1 stand for cited documents."""
    hits, _ = _fallback(spark, sf_dir)
    cited = table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("api:"), "doc_id").alias("document_id")).distinct()
    wiki = hits.join(cited, "document_id").select("query_id", F.lit("w").alias("wiki_id"), F.array(F.struct("rag_collection_id", "document_id")).alias("provenance"))
    requests = fallback.enrichment_requests(hits, fallback.missing_documents(hits, wiki, "w"))
    texts = hits.select("query_id", "document_id", F.md5(F.col("content").cast("binary")).alias("content_md5"))
    return requests.join(texts, ["query_id", "document_id"]).select("query_id", "rag_collection_id", "document_id", "wiki_id", "content_md5", "reason")
