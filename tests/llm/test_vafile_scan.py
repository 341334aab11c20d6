import random

import numpy as np
import pytest
from test_vafile import brute

from corvia.llm import vafile as V

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("held", [1 << 21, 50])
def test_copies_and_close_vectors(spark, monkeypatch, held):
    """A third of all rows hold one vector, others lie closer together than a cell; survivors are handed on early."""
    monkeypatch.setattr(V, "HELD", held)
    monkeypatch.setattr(V, "BLOCK", 100)
    rng = random.Random(7)
    common = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, common if i % 3 == 0 else [x + rng.gauss(0, 1e-3) for x in common] if i % 3 == 1 else [rng.gauss(0, 1) for _ in common]) for i in range(700)]
    rows.append((5, [100.0] * 8))  # stretches the grid
    assert sorted(map(tuple, V.query(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_large_components(spark):
    rows = [(0, [3e7, -2e7]), (1, [3e7, 1.0]), (2, [1e30, 1e30]), (3, [-1e30, 1.0]), (100, [1.0, 2.0]), (200, [3e6, 4e6])]
    clamp = lambda x: int(np.floor(max(-2.0**53, min(2.0**53, 1024 * float(np.float32(x))))))
    ints = [(i, [clamp(x) for x in v]) for i, v in rows]
    want = []
    for i, q in ints:
        if i % 100 == 0:
            scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c, strict=True)))), j) for j, c in ints if j != i)
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert sorted(map(tuple, V.query(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(want)


def test_a_task_hands_on_few(spark):
    """Of a stripe about k candidates per query leave the scan."""
    rng = np.random.default_rng(3)
    exact = rng.normal(0, 400, size=(6000, 32)).astype(int)
    file = V.VaFile(exact)
    weights, _, reach = V.weighed(exact[:40].astype(float), file.low, file.width)
    scan = V.Scan((32, 0, 0), 11)
    arrow = lambda m, t: V.pa.array(list(m), V.pa.list_(t))
    scan.ask(V.pa.RecordBatch.from_arrays([V.pa.array(range(40)), arrow(weights, V.pa.float32()), V.pa.array(reach)], ["key", "w", "reach"]))
    cells = (file.cells.astype(int) - 128).astype(np.int8)
    list(scan.meet(V.pa.RecordBatch.from_arrays([V.pa.array(range(6000)), arrow(cells, V.pa.int8())], ["key", "cells"])))
    found = {}
    for b in scan.finish():
        for q, c in zip(b["q"].to_pylist(), b["c"].to_pylist(), strict=True):
            found.setdefault(q, set()).add(c)
    for q in range(40):
        best = np.argsort(-(exact @ exact[q]), kind="stable")[:11]
        assert set(best.tolist()) <= found[q] and len(found[q]) < 200
