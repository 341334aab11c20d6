"""Queries of states, synchronization, duplicates, counters and benchmark cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators import cases, ranking, state, sync
from corvia.plans.registry import query, table
from corvia.streaming import hits
from corvia.tables import durable, new_folder

# Two snapshots of documents: the state of an earlier run and what is parsed now, and the local files.
DECIDED = """
parsed AS (
  SELECT doc_id::VARCHAR AS document_id, CASE WHEN source = 'src2' THEN 'https://h/new/' ELSE 'https://h/' END || doc_id AS uri, sha256(text) AS hash, sha256('f' || text) AS file FROM documents WHERE lang <> 'es'
), state AS (
  SELECT doc_id::VARCHAR AS document_id, 'https://h/' || doc_id AS uri, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS hash,
         CASE WHEN source = 'src3' THEN 'older' ELSE sha256('f' || text) END AS file, CASE WHEN source = 'src4' THEN 2 ELSE 0 END AS missing_count FROM documents WHERE lang <> 'de'
), files AS (
  SELECT doc_id::VARCHAR AS document_id, CASE WHEN source = 'src5' THEN 'edited' WHEN source = 'src6' THEN NULL ELSE sha256('f' || text) END AS current_hash, source = 'src7' AS same_content FROM documents
), decided AS (
  SELECT document_id, CASE
           WHEN p.uri IS NULL THEN CASE WHEN s.missing_count + 1 >= 3 THEN 'archived_candidate' ELSE 'missing' END
           WHEN s.uri IS NULL THEN CASE WHEN current_hash IS NULL THEN 'added' WHEN same_content THEN 'unchanged' ELSE 'updated' END
           WHEN s.hash <> p.hash THEN 'updated' WHEN s.uri <> p.uri THEN 'moved' WHEN current_hash = p.file THEN 'unchanged'
           WHEN current_hash IS DISTINCT FROM s.file THEN 'restored' ELSE 'unchanged' END AS operation,
         CASE WHEN p.uri IS NULL THEN s.missing_count + 1 ELSE 0 END::INT AS missing_count
  FROM parsed p FULL JOIN state s USING (document_id) LEFT JOIN files USING (document_id)
)"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    written = sha(F.concat(F.lit("f"), "text"))
    of = lambda name: F.col("source") == name
    parsed = docs.where("lang <> 'es'").select("document_id", F.concat(F.when(of("src2"), "https://h/new/").otherwise("https://h/"), "doc_id").alias("canonical_uri"), sha(F.col("text")).alias("content_hash"), written.alias("file_hash"))
    old = docs.where("lang <> 'de'").select("document_id", F.concat(F.lit("https://h/"), "doc_id").alias("canonical_uri"), sha(F.when(of("src1"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"), F.when(of("src3"), "older").otherwise(written).alias("file_hash"), F.when(of("src4"), 2).otherwise(0).alias("missing_count"))
    files = docs.select("document_id", F.when(of("src5"), "edited").when(~of("src6"), written).alias("current_hash"), of("src7").alias("same_content"))
    return sync.decide(parsed, old, files)


@query(f"WITH {DECIDED} SELECT * FROM decided")
def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("document_id", "operation", "missing_count")


@query(f"""
WITH {DECIDED}, n AS (
  SELECT count(*) AS documents, {", ".join(f"count(*) FILTER (operation = '{o}') AS {o}" for o in sync.OPERATIONS)} FROM decided
)
SELECT *, (added + updated + restored + moved)::DOUBLE / documents AS change_ratio, failed::DOUBLE / documents AS failure_ratio,
       (added + updated + restored + moved)::DOUBLE / documents >= 0.1 AS large_change, NOT (failed > 0 AND failed::DOUBLE / documents > 0.25) AS may_apply FROM n
""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.gates(sync.run_stats(decided(spark, sf_dir)))


@query(f"WITH {DECIDED} SELECT document_id, missing_count FROM decided WHERE operation = 'archived_candidate'")
def missing_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).where("operation = 'archived_candidate'").select("document_id", "missing_count")


PATHS = """paths AS (
  SELECT sha256(text) AS canonical_uri, CASE WHEN lang = 'en' THEN source || '/' || lang ELSE source END || '/' || doc_id || CASE WHEN n_chars < 500 THEN '-0123456789.md' ELSE '.md' END AS path, n_chars > 2000 AS in_state FROM documents
), best AS (
  SELECT canonical_uri, arg_max(path, (in_state::INT, CASE WHEN path LIKE '%-0123456789.md' THEN 0 ELSE 1 END, len(string_split(path, '/')), path)) AS keeper, count(*) AS copies FROM paths GROUP BY canonical_uri
)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("lang") == "en", F.concat("source", F.lit("/"), "lang")).otherwise(F.col("source"))
    path = F.concat(folder, F.lit("/"), "doc_id", F.when(F.col("n_chars") < 500, "-0123456789.md").otherwise(".md"))
    return table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("canonical_uri"), path.alias("path"), (F.col("n_chars") > 2000).alias("in_state"))


@query(f"WITH {PATHS} SELECT * FROM best")
def dedup_keeper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.keepers(paths(spark, sf_dir))


@query(f"WITH {PATHS} SELECT canonical_uri, path FROM paths JOIN best USING (canonical_uri) WHERE path <> keeper")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.quarantine(paths(spark, sf_dir)).select("canonical_uri", "path")


@query("SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) = 1")
def reject_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return state.reject_duplicates(docs, F.col("h")).select("doc_id")


@query("""
SELECT doc_id, CASE WHEN h IN (SELECT sha256(text) FROM documents WHERE lang = 'de') OR row_number() OVER (PARTITION BY h ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'inserted' END AS status
FROM (SELECT doc_id, sha256(text) AS h FROM documents)
""")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return state.insert_absent(docs.where("lang = 'de'").select("h"), docs.select("h", "doc_id"), ["h"]).select("doc_id", "status")


@query("""
SELECT vec_id AS id, 'orphan' AS problem FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
""")
def index_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.index_consistency(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("""
SELECT user_id::VARCHAR AS api_id, count(*) AS hits, (row_number() OVER (ORDER BY count(*) DESC, user_id::VARCHAR) - 1)::INT AS x FROM events
WHERE event_type = 'click' AND contains(user_id::VARCHAR, '1') GROUP BY user_id QUALIFY x < 20
""")
def heatmap_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("api_id"))
    return hits.top_hits(hits.count_hits(events), "click", 20, "1").select("api_id", "hits", "x")


@query("SELECT event_type AS collection, user_id::VARCHAR AS api_id, count(*) AS hits FROM events GROUP BY ALL")
def stream_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter as a stream over the events that are there, read back from its table."""
    folder = new_folder(spark, "stream-counter")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("event_type").alias("collection"), F.col("user_id").cast("string").alias("api_id"))
    hits.start_counter(stream, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return hits.counted(spark.read.parquet(f"{folder}/counts"))


@query("""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS start, event_type AS collection, count(*) AS hits FROM events GROUP BY ALL
""")
def windowed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("collection"), F.lit("all").alias("api_id"))
    return hits.windowed_hits(events).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("start"), "collection", "hits")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 1000) ORDER BY orders.o_orderdate DESC, o_orderkey DESC LIMIT 51
""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return ranking.keyset_page(orders, "o_orderdate", "o_orderkey", 50, (datetime.datetime(1998, 6, 1), 1000)).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("""
SELECT o_orderkey, CASE WHEN hit THEN 'X' ELSE o_orderstatus END AS o_orderstatus, (o_custkey % 3 + hit::INT)::BIGINT AS revision, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'kept' WHEN hit THEN 'updated' ELSE 'conflict' END AS outcome
FROM (SELECT *, o_orderpriority = '1-URGENT' AND o_custkey % 3 = 1 AS hit FROM orders)
""")
def optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stored = orders.select("o_orderkey", "o_orderstatus", (F.col("o_custkey") % 3).alias("revision"))
    patches = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit(1).alias("expected_revision"), F.lit("X").alias("o_orderstatus"))
    return state.optimistic_update(stored, patches, ["o_orderkey"])


@query("""
SELECT c_custkey, c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 1000000000, c_name, c_acctbal + 100 FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    building = customers.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100).drop("c_mktsegment")
    rows = building.union(building.withColumn("c_custkey", F.col("c_custkey") + 1000000000))
    return state.upsert(customers.drop("c_mktsegment"), rows, ["c_custkey"])


@query("""
SELECT doc_id, coalesce(a, 0)::BIGINT AS attempts, coalesce(p, 0)::BIGINT AS passes, CASE WHEN a > 0 THEN p::DOUBLE / a END AS pass_rate
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS a, sum(quality)::BIGINT AS p FROM labels GROUP BY doc_id) USING (doc_id)
""")
def pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("problem_id")).agg(F.count(F.lit(1)).alias("attempt_count"), F.sum("quality").alias("pass_count"))
    problems = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("problem_id"))
    return cases.pass_rates(problems, stats).select(F.col("problem_id").alias("doc_id"), F.col("attempts").cast("long").alias("attempts"), F.col("passes").cast("long").alias("passes"), "pass_rate")


@query("""
WITH c AS (
  SELECT source AS module, (row_number() OVER (PARTITION BY source ORDER BY doc_id::VARCHAR) - 1) // 5 AS chunk, doc_id::VARCHAR AS filename, lang FROM documents
), g AS (
  SELECT module, chunk, string_agg(filename, ',' ORDER BY filename) AS files, count(DISTINCT lang)::INT AS n_apis FROM c GROUP BY ALL HAVING count(*) >= 2
)
SELECT module, chunk, row_number() OVER (ORDER BY module, chunk) AS group_id, files, n_apis FROM g
""")
def similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("filename"), F.array("lang").alias("apis"))
    return cases.similar_groups(docs).select("module", "chunk", "group_id", F.array_join("files", ",").alias("files"), F.size("apis").alias("n_apis"))


@query("""
WITH records AS (SELECT conv_id * 1000 + turn AS ord, md5(text) AS question FROM conversations),
done AS (SELECT md5(text) AS question, length(text) > 200 AS cut FROM conversations WHERE role = 'assistant'),
counts AS (SELECT question, count(*) FILTER (NOT cut) AS finished, count(*) FILTER (cut) AS again FROM done GROUP BY question),
numbered AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ord) AS n FROM records)
SELECT ord, question, CASE WHEN n - coalesce(finished, 0) <= coalesce(again, 0) THEN 500 ELSE 200 END AS next_limit FROM numbered LEFT JOIN counts USING (question) WHERE n > coalesce(finished, 0)
""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("question", F.md5(F.col("text").cast("binary")))
    records = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "question")
    done = turns.where("role = 'assistant'").select("question", F.when(F.length("text") > 200, 200).otherwise(F.length("text") - 1).alias("output_length"), F.when(F.length("text") > 200, 200).otherwise(F.length("text")).alias("output_limit"))
    return cases.pending(records, done).select("ord", "question", "next_limit")


@query("""
WITH state AS (
  SELECT doc_id::VARCHAR AS document_id, md5(substr(text, 1, 40)) AS canonical_uri, source || CASE WHEN lang = 'en' THEN '/en/' ELSE '/' END || doc_id || '.md' AS relative_path, n_chars % 3 > 0 AS present, n_chars::BIGINT AS mtime FROM documents
), refs AS (
  SELECT canonical_uri, 'new:' || canonical_uri AS document_id, CASE WHEN count(*) > 2 THEN min(relative_path) END AS preferred_path FROM state GROUP BY canonical_uri HAVING min(document_id) LIKE '%1%'
), keyed AS (
  SELECT coalesce(r.document_id, s.document_id) AS document_id, canonical_uri, relative_path,
         row_number() OVER (PARTITION BY coalesce(r.document_id, s.document_id) ORDER BY (relative_path = preferred_path) IS TRUE DESC, present DESC, len(string_split(relative_path, '/')) DESC, mtime, relative_path DESC) AS n
  FROM state s LEFT JOIN refs r USING (canonical_uri)
)
SELECT document_id, canonical_uri, relative_path FROM keyed WHERE n = 1
""")
def sync_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States under the ids that their addresses have now, the preferred, existing, deepest, oldest file of each."""
    path = F.concat("source", F.when(F.col("lang") == "en", "/en/").otherwise("/"), "doc_id", F.lit(".md"))
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.md5(F.substring("text", 1, 40).cast("binary")).alias("canonical_uri"), path.alias("relative_path"), (F.col("n_chars") % 3 > 0).alias("present"), F.col("n_chars").cast("long").alias("mtime"))
    refs = old.groupBy("canonical_uri").agg(F.when(F.count(F.lit(1)) > 2, F.min("relative_path")).alias("preferred_path"), F.min("document_id").alias("_m")).where("_m LIKE '%1%'")
    return sync.reconcile(old, refs.withColumn("document_id", F.concat(F.lit("new:"), "canonical_uri"))).select("document_id", "canonical_uri", "relative_path")


@query(f"""
WITH {DECIDED}
SELECT document_id, CASE WHEN files.current_hash IS DISTINCT FROM parsed.file AND documents.source = 'src9' THEN 'failed' ELSE operation END AS operation
FROM decided JOIN parsed USING (document_id) JOIN files USING (document_id) JOIN documents ON documents.doc_id::VARCHAR = document_id WHERE operation IN ('added', 'updated', 'restored', 'moved')
""")
def sync_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open actions of a run's journal, tried again; the staged files of one source are lost."""
    found = decided(spark, sf_dir)
    actions = sync.journal(found, "run1", F.concat("document_id", F.lit(".md")), "/staging", "/backups")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source")
    staged = actions.join(sources, "document_id").where("source <> 'src9'").select(F.col("staging_path").alias("path"), F.col("file_hash").alias("hash"))
    there = staged.union(found.where("current_hash IS NOT NULL").select(F.concat("document_id", F.lit(".md")), "current_hash"))
    judged = sync.journal_problems(actions, "run1", "/staging", "/backups", there)
    state_ = found.select("document_id", F.col("old_uri").alias("canonical_uri"), F.col("old_hash").alias("content_hash"), F.col("old_file").alias("file_hash"), "missing_count")
    return sync.resume(actions, state_, judged)[2].select("document_id", "operation")


@query(f"""
WITH {DECIDED}
SELECT document_id, operation, CASE WHEN operation NOT IN ('added', 'updated', 'restored', 'moved') THEN NULL WHEN document_id LIKE '%3' THEN 'settled' ELSE 'written' END AS outcome,
       CASE WHEN operation IN ('added', 'updated', 'restored', 'moved') THEN parsed.file END AS lies_there
FROM decided LEFT JOIN parsed USING (document_id)
""")
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is killed when a tenth of its files are written, and taken up again: what each document's action came
    to the second time, and the hash of the file that lies there."""
    from corvia.operators.apply import Runs, apply_actions

    folder = new_folder(spark, "sync-apply")
    runs = Runs(spark, f"{folder}/runs", f"{folder}/documents")
    found = durable(decided(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "source", F.concat(F.lit("f"), "text").alias("text"))
    texts = docs.select("document_id", F.concat("source", F.lit("/"), "document_id", F.lit(".md")).alias("target_path"), "text")
    with runs.lock("run1"):
        actions = runs.begin("run1", found, texts)
        apply_actions(actions.where("document_id LIKE '%3'"), runs.workspace).write.format("noop").mode("overwrite").save()
        outcomes = runs.apply("run1")
        runs.finish("run1", found, outcomes)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(runs.workspace)
    there = there.select(F.regexp_extract("path", r"([^/]+)[.]md$", 1).alias("document_id"), F.sha2("content", 256).alias("lies_there"))
    return found.select("document_id", "operation").join(outcomes.select("document_id", "outcome"), "document_id", "left").join(there, "document_id", "left")


@query()
def test_set_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt to ten rounds, with what goes into each question; draws are by a hash that SQL lacks."""
    from corvia.plans import knowledge

    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("module"), F.col("doc_id").cast("string").alias("filename"), F.array("lang").alias("apis"))
    used = docs.where("filename LIKE '%7'").select("filename")
    return knowledge.test_set_rounds(docs.select("filename", "module"), cases.similar_groups(docs), used, 10, 7).select("round", "filename", "mode", F.array_join("selected", ",").alias("selected"))
