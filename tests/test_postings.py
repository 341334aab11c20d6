import random

import pytest
from pyspark.sql import functions as F

from corvia.operators import retrieval
from corvia.operators.catalog import Conflict
from corvia.operators.frequencies import Frequencies
from corvia.operators.postings import Postings


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.choice([5, 20, 60, 400])))) for i in range(6000)] + [(6000, None), (6001, ""), (6002, "w1 w1 w1"), (6003, "w1 w1 w1")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def test_the_best_of_all_documents(spark, corpus, tmp_path):
    rng = random.Random(2)
    queries = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 8])))) for q in range(60)] + [(90, "nothing here"), (91, ""), (92, None)], "query_id long, text string")
    index = Postings(spark, f"{tmp_path}/index").build(corpus, retrieval.document_frequency(corpus, F.col("text")), corpus.count())
    for k in (1, 10):
        found, effort = index.search(queries, k)
        want = retrieval.sparse_top_k(corpus, queries, k)
        rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())
        assert rows(found) == rows(want)
        counts = effort.agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).first()
        assert counts["read"] * 2 < counts["blocks"], counts  # under half of the blocks that hold a token


def test_few_documents_and_more_than_there_are(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, "d")], "doc_id long, text string")
    queries = spark.createDataFrame([("x", "b c"), ("y", "d")], "query_id string, text string")
    index = Postings(spark, f"{tmp_path}/index").build(docs, retrieval.document_frequency(docs, F.col("text")), 3)
    assert sorted((r["query_id"], r["id"]) for r in index.search(queries, 10)[0].collect()) == [("x", 1), ("x", 2), ("y", 3)]


def recounted(docs):
    return {r["token"]: r["df"] for r in retrieval.document_frequency(docs, F.col("text")).collect()}


def test_frequencies_after_a_thousand_changes(spark, corpus, tmp_path):
    rng = random.Random(3)
    held = {r["doc_id"]: r["text"] for r in corpus.collect()}
    kept = Frequencies(spark, f"{tmp_path}/df")
    assert kept.current()[1] == 0 and kept.current()[0].count() == 0
    kept.update(corpus)
    frame = lambda texts: spark.createDataFrame([(t,) for t in texts], "text string")
    for _ in range(4):  # 250 changes each
        came, went = [], []
        for _ in range(250):
            doc = rng.choice(list(held))
            if rng.random() < 0.4:
                went.append(held.pop(doc))
            else:
                went.append(held[doc])
                held[doc] = f"{held[doc] or ''} new{rng.randrange(9)}"
                came.append(held[doc])
        kept.update(frame(came), frame(went))
    df, n = kept.current()
    now = frame(list(held.values()))
    assert n == len(held) and {r["token"]: r["df"] for r in df.collect()} == recounted(now)
    assert {r["token"]: r["df"] for r in kept.current(1)[0].collect()} == recounted(corpus)
    kept.summarize()
    assert {r["token"]: r["df"] for r in kept.current()[0].collect()} == recounted(now) and kept.current()[1] == n
    with pytest.raises(Conflict):
        kept.update(frame(["late"]), base=2)
    queries = spark.createDataFrame([(1, "w3 w9 new1")], "query_id long, text string")
    docs = spark.createDataFrame(list(held.items()), "doc_id long, text string")
    index = Postings(spark, f"{tmp_path}/index").build(docs, *kept.current())
    assert [r["id"] for r in index.search(queries, 5)[0].orderBy("rank").collect()] == [r["id"] for r in retrieval.sparse_top_k(docs, queries, 5).orderBy("rank").collect()]
