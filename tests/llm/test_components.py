import random

import pytest

from corvia.llm import simhash as S


def brute(links):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def classes(df):
    rows = df.collect()
    found = {r["node"]: r["label"] for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("links", [[], [(2, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(100, i) for i in range(30)], [(i, i + 7) for i in range(50)] + [(3, 3)]])
def test_shapes(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    want = brute([(a, b) for a, b in links if a != b])
    assert {n: x for n, x in classes(S.components(frame.where("a <> b"))).items()} == want


def test_new_links(spark):
    rng = random.Random(5)
    first, second = ([(rng.randrange(120), rng.randrange(120)) for _ in range(n)] for n in (40, 50))
    first, second = ([(a, b) for a, b in links if a != b] for links in (first, second))
    found = S.components(spark.createDataFrame(first, "a long, b long"))
    assert classes(S.extended(found, spark.createDataFrame(second, "a long, b long"))) == brute(first + second)
    assert classes(S.extended(found, spark.createDataFrame([], "a long, b long"))) == brute(first)
