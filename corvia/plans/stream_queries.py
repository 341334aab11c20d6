"""Queries of streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.plans.registry import query, table
from corvia.streaming import updates
from corvia.tables import new_folder


def first_line(text: str) -> str:
    """A stand-in for extraction; texts without a full stop in their first line can't be processed."""
    line = text.split("\n", 1)[0]
    if "." not in line:
        raise ValueError("no sentence")
    return line[: line.index(".") + 1]


@query("""
WITH d AS (SELECT doc_id::VARCHAR AS document_id, source, lang, text FROM documents WHERE text IS NOT NULL),
v AS (
  SELECT 1 AS day, document_id, md5(text) AS hash, split_part(text, chr(10), 1) AS line FROM d WHERE lang <> 'de'
  UNION ALL SELECT 2, document_id, md5(text), split_part(text, chr(10), 1) FROM d WHERE source <> 'src1'
  UNION ALL SELECT 2, document_id, md5('New. ' || text), split_part('New. ' || text, chr(10), 1) FROM d WHERE source = 'src1'
), j AS (
  SELECT a.*, contains(a.line, '.') AS fine, b.hash AS old, b.document_id IS NOT NULL AND contains(b.line, '.') AS known
  FROM v a LEFT JOIN v b ON a.day = 2 AND b.day = 1 AND a.document_id = b.document_id
)
SELECT day, document_id, CASE WHEN known AND old = hash THEN 'unchanged' WHEN NOT fine THEN 'needs_review' WHEN known THEN 'updated' ELSE 'created' END AS action,
       (known::INT + (NOT (known AND old = hash) AND fine)::INT)::INT AS revision_number,
       CASE WHEN fine AND NOT (known AND old = hash) THEN substr(line, 1, strpos(line, '.')) END AS result
FROM j
""")
def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of documents through a stream that is stopped and started between them."""
    folder = new_folder(spark, "stream-updates")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    own = F.col("source") == "src1"
    days = [docs.where("lang <> 'de'"), docs.withColumn("text", F.when(own, F.concat(F.lit("New. "), "text")).otherwise(F.col("text")))]
    updates.use_rocksdb(spark)
    for day, some in enumerate(days, 1):
        rows = some.select(F.col("doc_id").cast("string").alias("document_id"), F.md5(F.col("text").cast("binary")).alias("content_hash"), F.lit("f").alias("fingerprint"), "text", F.timestamp_seconds(F.lit(86400 * day)).alias("updated_at"))
        rows.write.mode("append").parquet(f"{folder}/documents")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/documents")
        updates.start_updates(updates.outcomes(stream, first_line), f"{folder}/outcomes", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.schema(updates.OUTCOME).parquet(f"{folder}/outcomes")
    return found.select((F.unix_seconds("at") / 86400).cast("int").alias("day"), "document_id", "action", "revision_number", "result")
