import duckdb
import pytest
from pyspark.sql import functions as F

from corvia.llm import mixing as M
from corvia.llm.common import n_words_of


def water(sizes, weights, share=1.5, most=2):
    """Targets by sharing the excess again until none is over its ceiling."""
    goal, full = share * sum(sizes), [False] * len(sizes)
    while True:
        rest = goal - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        w = sum(w for w, f in zip(weights, full, strict=True) if not f)
        found = [most * s if f else rest * x / w for s, x, f in zip(sizes, weights, full, strict=True)]
        over = [i for i, t in enumerate(found) if not full[i] and t > most * sizes[i] * (1 + 1e-12)]
        if not over:
            return found
        for i in over:
            full[i] = True


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 50, 400], [1, 1, 1, 5000], [0, 7, 0, 90, 33, 12]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"0{i}", s) for i, s in enumerate(sizes)], "_key string, size long")
    found = [r["target"] for r in M.targets(rows).orderBy("_key").collect()]
    assert found == pytest.approx(water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_oracle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, M.query(docs).select(*names).collect())) == sorted(tuple(r) for r in duckdb.sql(M.ORACLE).select(*names).fetchall())


def test_odd_rows(odd_docs, no_docs):
    mixed = M.mix(odd_docs)
    assert set(odd_docs.columns) <= set(mixed.columns)
    rows = mixed.collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, M.mix(odd_docs).collect()))
    assert M.mix(no_docs).count() == M.emit(no_docs).count() == 0
    emitted = M.emit(odd_docs)
    assert emitted.columns == odd_docs.columns and {r["size"] for r in emitted.collect()} == {"clash"}


def test_taken_near_target(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    found = M.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 97 for r in found) and len(found) == 3


def test_words(spark):
    text = "a b c\x0bd\x1ce f\r\n  g"
    assert spark.createDataFrame([(text,), (None,), (" ",)], "t string").select(n_words_of(F.col("t"))).collect()[0][0] == 4
