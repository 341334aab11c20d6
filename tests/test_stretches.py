"""Documents are scored a stretch at a time, whatever the size of a batch, and a batch passes on k rows for each query."""

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvia.operators import retrieval


def narrow_channel():
    """A channel that goes to the workers by value, and refuses more than a stretch."""

    class Narrow(retrieval.Channel):
        def scores(self, doc, row, value, n):
            assert n <= 512, n
            return super().scores(doc, row, value, n)

    made = (0, {"a": (0, 1.0), "b": (1, 1.0)}, np.eye(2), ["x", "y"], True)

    class Sent(retrieval.Channel):
        def __reduce__(self):
            return cloudpickle.loads, (cloudpickle.dumps(Narrow(*made)),)

    return Sent(*made)


def test_a_batch_of_many_stretches(spark):
    docs = spark.range(3000, numPartitions=1).select("id", F.concat(F.repeat(F.lit("a "), (F.col("id") % 7).cast("int")), F.repeat(F.lit("b "), (F.col("id") % 5).cast("int"))).alias("text"))
    queries = spark.createDataFrame([("x", "a"), ("y", "b")], "query_id string, text string")
    found = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in retrieval._scored(docs, "id", "text", [narrow_channel()], queries, 700).collect())
    want = []
    for name, m in (("x", 7), ("y", 5)):
        best = sorted((-(i % m), i) for i in range(3000) if i % m)[:700]
        want += [(name, k, i, float(-s)) for k, (s, i) in enumerate(best, 1)]
    assert found == sorted(want)


def test_the_first_of_each_column():
    at = retrieval.first_of(pa.array([5, 3, 9, 1, 2]), np.array([0, 0, 1, 0, 1]), np.array([1.0, 2.0, 1.0, 2.0, 3.0]), 2)
    assert at.tolist() == [3, 1, 4, 2]
