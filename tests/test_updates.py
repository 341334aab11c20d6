import datetime

import pytest
from pyspark.sql import functions as F

from corvia.streaming import updates as U

ROW = "document_id string, content_hash string, fingerprint string, text string, updated_at timestamp"


def extraction():
    """A function that goes to the workers by value."""

    def extract(text):
        if "bad" in text:
            raise ValueError("can't be read")
        return text.upper()

    return extract


class Feed:
    """Files that come one by one, and a stream that is started anew for each."""

    def __init__(self, spark, folder, **more):
        self.spark, self.folder, self.more = spark, folder, more
        U.use_rocksdb(spark)

    def day(self, n, *rows):
        at = lambda k: datetime.datetime(2024, 1, n) + datetime.timedelta(minutes=k)
        made = self.spark.createDataFrame([(d, h, "f", t, at(k)) for k, (d, h, t) in enumerate(rows)], ROW)
        made.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(ROW).parquet(f"{self.folder}/in")
        query = U.start_updates(U.outcomes(stream, extraction(), **self.more), f"{self.folder}/out", f"{self.folder}/checkpoint")
        query.awaitTermination()
        self.progress = query.recentProgress
        found = self.spark.read.schema(U.OUTCOME).parquet(f"{self.folder}/out").where(F.to_date("at") == F.lit(f"2024-01-{n:02}").cast("date"))
        return sorted((r["document_id"], r["action"], r["revision_number"], r["missing_count"], r["result"] or r["issue"]) for r in found.collect())


def test_outcomes_across_restarts(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    assert feed.day(1, ("a", "1", "x"), ("b", "1", "bad"), ("c", "1", "z")) == [("a", "created", 1, 0, "X"), ("b", "needs_review", 0, 0, "ValueError: can't be read"), ("c", "created", 1, 0, "Z")]
    assert feed.day(2, ("a", "1", "x"), ("b", "2", "y"), ("c", None, None)) == [("a", "unchanged", 1, 0, None), ("b", "created", 1, 0, "Y"), ("c", "missing", 1, 1, None)]
    # several rows of one document, in the order of their times; a failure leaves the state as it was
    assert feed.day(3, ("a", "2", "xx"), ("a", "3", "bad"), ("a", "2", "xx"), ("c", "1", "z")) == [("a", "needs_review", 2, 0, "ValueError: can't be read"), ("a", "unchanged", 2, 0, None), ("a", "updated", 2, 0, "XX"), ("c", "restored", 1, 0, None)]
    for n, action in ((4, "missing"), (5, "missing"), (6, "archived_candidate")):
        assert feed.day(n, ("b", None, None), ("d", None, None))[0][:2] == ("b", action)


def test_a_batch_reads_its_own_keys(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.day(1, *[(f"d{i}", "1", "t") for i in range(400)])
    assert len(feed.day(2, ("d7", "2", "u"), ("d9", "1", "t"), ("new", "1", "v"))) == 3
    states = [s for p in feed.progress for s in p["stateOperators"] if p["numInputRows"]]
    assert sum(s["numRowsUpdated"] for s in states) <= 3 and states[-1]["numRowsTotal"] >= 401
    gets = sum(s["customMetrics"].get("rocksdbGetCount", 0) for s in states)
    assert 0 < gets < 40, gets  # not the 400 that are known


def test_timers_miss_what_does_not_come(spark, tmp_path):
    feed = Feed(spark, tmp_path, patience=datetime.timedelta(days=3), late="1 minute")
    feed.day(1, ("a", "1", "x"), ("b", "1", "y"))
    feed.day(2, ("a", "1", "x"), ("b", "1", "y"))
    feed.day(9, ("b", "1", "y"))
    feed.day(20, ("b", "1", "y"))
    feed.day(21, ("b", "1", "y"))
    found = spark.read.schema(U.OUTCOME).parquet(f"{tmp_path}/out").where("document_id = 'a'").orderBy("at", "missing_count").collect()
    assert [r["action"] for r in found][:2] == ["created", "unchanged"] and [r["action"] for r in found][-1] == "archived_candidate"
    assert [r["missing_count"] for r in found][2:] == [1, 2, 3]


def test_states_of_a_table_are_where_it_begins(spark, tmp_path):
    known = spark.createDataFrame([("a", "1", "f", 4, 0, datetime.datetime(2023, 1, 1))], f"document_id string, {U.STATE}")
    feed = Feed(spark, tmp_path, known=known)
    assert feed.day(1, ("a", "1", "x"), ("b", "1", "y")) == [("a", "unchanged", 4, 0, None), ("b", "created", 1, 0, "Y")]
    assert feed.day(2, ("a", "2", "z"))[0][:3] == ("a", "updated", 5)


@pytest.fixture(autouse=True)
def default_store(spark):
    yield
    for name in ("providerClass", "rocksdb.changelogCheckpointing.enabled"):
        spark.conf.unset(f"spark.sql.streaming.stateStore.{name}")
