"""Sparse vectors are counted where texts are read: against sums over exploded tokens, and by what is shuffled."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from corvia.operators import retrieval


def plain(df, docs, n):
    """{(id, token_id): weight} by sums in Python."""
    seen = {r["token"]: r["df"] for r in df.collect()}
    ids = {r["token"]: r["token_id"] for r in df.select("token", retrieval.token_id(F.col("token")).alias("token_id")).collect()}
    counts = {}
    for i, text in docs:
        counts.setdefault(i, Counter()).update((text or "").lower().split())
    found = {}
    for i, c in counts.items():
        for t, tf in c.items():
            if t in seen:
                key = (i, ids[t])
                found[key] = max(found.get(key, 0.0), tf * math.log1p(n / seen[t]))
    return {k: round(v, 9) for k, v in found.items()}


def test_ids_that_share_a_number_and_rows_that_share_an_id(spark, monkeypatch):
    # so few numbers that tokens share them: those of one document and of several
    few = lambda token: F.pmod(F.hash(token), F.lit(7))
    monkeypatch.setattr(retrieval, "token_id", few)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(30)], k=rng.choice([1, 3, 40])))) for i in range(40)] + [(7, "w1 w1 new"), (None, "w1"), (None, "w2 w1"), (50, None), (51, ""), (52, "unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = docs.where("text <> 'unseen' OR text IS NULL")
    df = retrieval.document_frequency(known, F.col("text"))
    for some in (rows, rows[:40]):
        frame = spark.createDataFrame(some, "doc_id long, text string")
        for most in (retrieval.FEW_TOKENS, 0):
            monkeypatch.setattr(retrieval, "FEW_TOKENS", most)
            found = retrieval.sparse_vectors(frame, "doc_id", F.col("text"), df, 46).collect()
            assert len({(r["doc_id"], r["token_id"]) for r in found}) == len(found)
            assert {(r["doc_id"], r["token_id"]): round(r["weight"], 9) for r in found} == plain(df, some, 46)


def test_one_shuffle_for_the_tokens_of_documents(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "FEW_TOKENS", 0)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    df = retrieval.document_frequency(docs, F.col("text"))
    plan = retrieval.sparse_vectors(docs, "doc_id", F.col("text"), df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 2, plan  # one of the documents' tokens, one of the frequencies
