import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.operators import retrieval
from corvia.operators.vector_index import Codebook, VectorIndex, recall, unit


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 18))
    rows = [(i, ["a", "b", None][i % 3], (centers[i % 30] + 0.6 * rng.normal(size=18)).tolist()) for i in range(3000)]
    rows += [(3000, "a", None), (3001, "a", []), (3002, "a", [0.0] * 18), (3003, "a", [float("nan")] * 18), (3004, "a", [None, *[1.0] * 17]), (3005, "b", rows[1][2])]
    return spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("index"))).build(vectors, scope=F.col("label"))


@pytest.fixture(scope="module")
def queries(vectors):
    return vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def wanted(vectors, queries):
    """Exact search in each scope on its own."""
    found = None
    for scope in ("a", "b", None):
        own = retrieval.dense_top_k(vectors.where(F.col("label").eqNullSafe(F.lit(scope))), queries.where(F.col("scope").eqNullSafe(F.lit(scope))), 10)
        found = own if found is None else found.union(own)
    return found.cache()


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


def test_exact_search(index, vectors, queries, wanted):
    assert rows(index.search(vectors, queries, 10, exact=True)) == rows(wanted)


def test_recall_of_a_few_lists(index, vectors, queries, wanted):
    assert recall(index.search(vectors, queries, 10), wanted) >= 0.9
    assert len(index.book().centroids) > 40 and recall(index.search(vectors, queries, 10, probes=1), wanted) < 1


def test_tuning_finds_how_many_lists_do(index, vectors, queries, wanted):
    probes = index.tuned(vectors, 10, 0.95, scope=F.col("label"))
    assert 1 < probes <= 32 and recall(index.search(vectors, queries, 10, probes=probes), wanted) >= 0.9
    assert index.tuned(vectors, 10, 0.0, scope=F.col("label")) == 1


def test_every_usable_row_is_indexed(spark, index):
    codes = spark.read.parquet(f"{index.folder}/codes")
    assert codes.count() == 3001 and codes.select("id").distinct().count() == 3001


def test_bounds_hold():
    rng = np.random.default_rng(2)
    sample = unit(rng.normal(size=(500, 10)))
    book = Codebook.fit(sample[:300], 12)
    lists, codes, error = book.encode(sample)
    queries = unit(rng.normal(size=(20, 10)))
    to_lists, to_words = book.tables(queries)
    said = to_lists[:, lists] + to_words[:, np.arange(codes.shape[1])[None, :], codes].sum(axis=2)
    assert (np.abs(said - queries @ sample.T) <= error + 1e-5).all()


def test_passes_few_rows_and_no_queries(spark, index, vectors, queries, wanted, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 30)
    assert rows(index.search(vectors, queries, 10, exact=True)) == rows(wanted)
    assert index.search(vectors, queries.limit(0), 10).count() == 0
    few = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 1.0])], "vec_id string, embedding array<double>")
    small = VectorIndex(spark, f"{tmp_path}/small").build(few)
    asked = spark.createDataFrame([("q", None, [2.0, 0.1]), ("none", None, None)], "query_id string, scope string, vector array<double>")
    assert [(r["query_id"], r["id"]) for r in small.search(few, asked, 5).orderBy("rank").collect()] == [("q", "x"), ("q", "y")]
    with pytest.raises(ValueError):
        VectorIndex(spark, f"{tmp_path}/none").build(few.limit(0))
