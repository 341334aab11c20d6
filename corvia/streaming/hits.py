"""Hit counting: batch and Structured Streaming over the same rows, and the reports on the counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvia.functions.text import display_api_name
from corvia.sources.log import Log, delete, names

KEY = ["collection", "api_id"]
COUNTS = "collection string, api_id string, hits long"


def countable(hits: DataFrame) -> DataFrame:
    """Hits with a collection and an api id."""
    return hits.where((F.coalesce("collection", F.lit("")) != "") & (F.coalesce(F.col("api_id").cast("string"), F.lit("")) != ""))


def count_hits(hits: DataFrame) -> DataFrame:
    """(collection, api_id, hits); the same for a table and for a stream, whose state is one counter per key."""
    return countable(hits).groupBy(*KEY).agg(F.count(F.lit(1)).alias("hits"))


def windowed_hits(hits: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per event-time window (ts); rows later than ``late`` are dropped and old windows leave the state."""
    return countable(hits).withWatermark("ts", late).groupBy(F.window("ts", every), *KEY).agg(F.count(F.lit(1)).alias("hits"))


def start_counter(hits: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the counts of a stream in a Parquet table: each batch adds its counts to what is there.

    Batches are numbered and a batch that is run again replaces its own rows, so counts survive a lost executor.
    """

    def merge(batch: DataFrame, number: int) -> None:
        count_hits(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = hits.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _batches(spark: SparkSession, sink: str, after: int) -> list[int]:
    return sorted(n for n in (int(x.split("=")[1]) for x in names(spark, sink) if x.startswith("batch=")) if n > after)


def read_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The counts of a counter's table: its last summary and the batches after it."""
    log = Log(spark, f"{sink}-summaries")
    summary, _ = log.since_summary(1 << 60, entries=False)
    upto = summary["upto"] if summary else -1
    folders = [f"{sink}/batch={n}" for n in _batches(spark, sink, upto)] + ([f"{sink}-summaries/{summary['rows']}"] if summary else [])
    rows = spark.read.schema(COUNTS).parquet(*folders) if folders else spark.createDataFrame([], COUNTS)
    return counted(rows)


def summarize_counts(spark: SparkSession, sink: str) -> int:
    """Put all batches but the last one (which may be run again) together and remove them; the last one that is in.

    Readers that listed the batches before may have to list them anew.
    """
    log = Log(spark, f"{sink}-summaries")
    summary, _ = log.since_summary(1 << 60, entries=False)
    upto = summary["upto"] if summary else -1
    some = _batches(spark, sink, upto)[:-1]
    if not some:
        return upto
    rows = f"rows-{uuid.uuid4().hex}"
    parts = [f"{sink}/batch={n}" for n in some] + ([f"{sink}-summaries/{summary['rows']}"] if summary else [])
    counted(spark.read.schema(COUNTS).parquet(*parts)).write.parquet(f"{sink}-summaries/{rows}")
    if not log.summarize(some[-1] + 1, {"upto": some[-1], "rows": rows}):
        return upto
    for n in some:
        delete(spark, f"{sink}/batch={n}")
    return some[-1]


def counted(table: DataFrame) -> DataFrame:
    """The sums over the batches of a counter's table."""
    return table.groupBy(*KEY).agg(F.sum("hits").alias("hits"))


def top_hits(counts: DataFrame, collection: str | None, n: int = 100, keyword: str = "") -> DataFrame:
    """(api_id, api_name, hits, x): the n most frequent of a collection, by hits and then id; x is the place from 0."""
    from pyspark.sql import Window

    found = counts.where("hits > 0")
    if collection is not None:
        found = found.where(F.col("collection") == collection)
    if keyword.strip():
        found = found.where(F.contains(F.lower(F.col("api_id").cast("string")), F.lit(keyword.strip().lower())))
    some = found.orderBy(F.desc("hits"), "api_id").limit(max(0, n))
    place = F.row_number().over(Window.orderBy(F.desc("hits"), "api_id")) - 1  # of n rows
    return some.withColumn("api_name", display_api_name(F.col("api_id").cast("string"))).withColumn("x", place)


def collections(counts: DataFrame) -> DataFrame:
    return counts.select("collection").distinct().orderBy("collection")


def latest_updates(stream: DataFrame, key: str = "document_id", order: Column | None = None) -> DataFrame:
    """The last version of each document in a batch, to be merged by ``foreachBatch``."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), order if order is not None else F.col("updated_at")).alias("_r")).select(key, "_r.*")


def start_document_updates(stream: DataFrame, read_state, write_state, checkpoint: str) -> StreamingQuery:
    """Merge a stream of documents (document_id, content_hash, fingerprint, updated_at, ...) into a state table.

    read_state() gives the state, write_state(df, batch) stores the next one. Documents whose content hash and
    fingerprint are known are passed over; a batch that is run again finds its documents known and changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        state = read_state(batch.sparkSession)
        fresh = latest_updates(batch)
        changed = fresh.join(state.select("document_id", "content_hash", "fingerprint"), ["document_id", "content_hash", "fingerprint"], "left_anti")
        write_state(state.join(changed.select("document_id"), "document_id", "left_anti").unionByName(changed, allowMissingColumns=True), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
