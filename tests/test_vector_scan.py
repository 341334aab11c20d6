import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.operators import retrieval, vector_index
from corvia.operators.vector_index import Codebook, VectorIndex, recall, unit
from corvia.tables import durable


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors without clusters, whose codes say little."""
    rng = np.random.default_rng(7)
    rows = [(i, ["a", "b"][i % 2], rng.normal(size=30).tolist()) for i in range(2000)]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("scan"))).build(vectors, scope=F.col("label"))


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def wanted(vectors, queries):
    found = [retrieval.dense_top_k(vectors.where(F.col("label") == s), queries.where(F.col("scope") == s), 10) for s in ("a", "b")]
    return found[0].union(found[1]).cache()


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def test_exact_search_reads_few_vectors_and_all_queries_at_once(index, vectors, queries, wanted, monkeypatch):
    sizes = []

    def counted(df):
        out = durable(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(vector_index, "durable", counted)
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 20)
    assert rows(index.search(vectors, queries, 10, exact=True)) == rows(wanted)
    assert len(sizes) <= 3 and max(sizes) <= 15 * 80  # of 80 queries, with 1,000 rows each in their scope


def test_sets_stripes_and_small_batches(index, vectors, queries, wanted, monkeypatch):
    few = rows(index.search(vectors, queries, 10, probes=4))
    for name, value in (("SET", 7), ("STRIPE", 90), ("STRIPES", 5), ("ASKED", 3), ("MET", 16), ("HELD", 200)):
        monkeypatch.setattr(vector_index, name, value)
    assert rows(index.search(vectors, queries, 10, exact=True)) == rows(wanted)
    assert rows(index.search(vectors, queries, 10, probes=4)) == few


def test_tuning_in_one_scan_is_what_searches_give(index, vectors):
    own = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(vector_index.TUNING)
    asked = own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector")).cache()
    wanted = index.search(vectors, asked, 10, exact=True).cache()
    shares = {p: recall(index.search(vectors, asked, 10, probes=p), wanted) for p in (4, 8, 16)}
    assert shares[4] < shares[8] < shares[16]
    assert index.tuned(vectors, 10, shares[8], scope=F.col("label")) == 8
    assert index.tuned(vectors, 10, shares[8] + 1e-6, scope=F.col("label")) == 16
    assert index.tuned(vectors, 10, 1.1, scope=F.col("label")) == len(index.book().centroids)


def test_bytes_bound_what_is_left():
    rng = np.random.default_rng(3)
    some = unit(rng.normal(size=(400, 10)))
    book = Codebook.fit(some[:200], 8)
    lists, codes, coarse = book.encode(some)
    fine, step, error = book.refine(some, lists, codes)
    said = book.said(lists, codes) + fine * step[:, None]
    queries = book.padded(unit(rng.normal(size=(20, 10))))
    assert (np.abs(queries @ said.T - queries @ book.padded(some).T) <= error + 1e-5).all()
    assert error.mean() < coarse.mean() / 20


def test_repeated_rows_are_candidates_each(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1.0])]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, None, [2.0, 0.1])], "query_id long, scope string, vector array<double>")
    small = VectorIndex(spark, f"{tmp_path}/few").build(few)
    for exact in (False, True):
        assert [r["id"] for r in small.search(few, asked, 5, exact=exact).orderBy("rank").collect()] == [1, 1, 2]
