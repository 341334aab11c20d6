import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.llm import vafile as V


def brute(rows, k=10):
    ok = [(i, n, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, q in ok:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, m, c in ok if m != n and len(c) == len(q))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "queries"), [(8192, 2048), (64, 2)])
def test_against_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "QUERIES", queries)
    rng = random.Random(4)
    vector = lambda: [rng.choice([rng.gauss(0, 1), 0.25, -1.0]) for _ in range(6)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(300, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (100, vector()), (400, None), (500, [1.0, None]), (600, [float("nan")] * 6), (700, [float("inf")] + [0.0] * 5), (None, vector()), (800, []), (801, []), (900, [3e4] * 6), (1000, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    assert sorted(map(tuple, V.query(frame).collect())) == brute(rows)


def test_empty(spark):
    assert V.query(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    exact, asked = rng.integers(-5000, 5000, size=(500, 16)), rng.integers(-5000, 5000, size=(20, 16))
    middle, reach = V.VaFile(exact).bounds(asked)
    assert (np.abs(asked @ exact.T - middle) <= reach[:, None]).all()
