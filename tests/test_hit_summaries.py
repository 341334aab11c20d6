import datetime

from corvia.streaming import hits


def test_summaries_of_batches(spark, tmp_path):
    """Counts stay the same when batches are put together, and more come after it."""
    sink, schema, want = f"{tmp_path}/counts", "collection string, api_id string, ts timestamp", {}
    assert hits.read_counts(spark, sink).count() == 0
    for day in range(7):
        rows = [("c", f"a{i % (day + 2)}", datetime.datetime(2024, 1, day + 1)) for i in range(10)]
        for c, a, _ in rows:
            want[c, a] = want.get((c, a), 0) + 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        hits.start_counter(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sink, f"{tmp_path}/checkpoint").awaitTermination()
        if day in (3, 5):
            assert hits.summarize_counts(spark, sink) == day - 1
        assert {(r["collection"], r["api_id"]): r["hits"] for r in hits.read_counts(spark, sink).collect()} == want
    assert len([p for p in (tmp_path / "counts").iterdir() if p.name.startswith("batch=")]) == 2
