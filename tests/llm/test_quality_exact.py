import random

import pytest
from pyspark.sql import functions as F
from test_quality import brute

from corvia.llm import quality as Q


def test_cutoff():
    assert Q.cutoff_of(0.001) == pytest.approx(18.467, abs=0.01) and Q.cutoff_of(0.5) == pytest.approx(3.357, abs=0.001)


def counted(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["n_repeat_words"] for r in Q.with_statistics(docs).orderBy("doc_id").collect()]


def test_hashes_that_collide(spark, monkeypatch):
    """Windows of one hash and different words are told apart by their words."""
    real = F.xxhash64
    monkeypatch.setattr(Q.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(5)) if len(c) == 3 else real(*c))
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(4, 60))) for _ in range(60)]
    assert counted(spark, texts) == [brute(t)[4] for t in texts]


def test_a_very_long_text(spark):
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(700)) for _ in range(400_000))]
    assert counted(spark, texts) == [brute(t)[4] for t in texts]


def test_clashing_names(spark):
    rows = [(i, "some words of a text " * (10 + i % 7), "en", "a") for i in range(200)]
    clashing = ["scale", "d2", "m_x0", "l_0_0", "x0", "x3", "size", "start", "bin", "z_0", "_r", "w", "n", "e", "kept", "distance"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("clash") for c in clashing})
    found = Q.judge(docs)
    assert found.count() == 200 and set(docs.columns) <= set(found.columns)
    assert found.select("scale", "x0").distinct().collect() == [("clash", "clash")] and dict(found.dtypes)["kept"] == "boolean"
