"""Edges come from one shuffle and one sort of the relations, whatever their number of types, loops and nulls."""

import random

from corvia.operators import graph

RELATION = "source_id string, target_id string, target_name string, relation_type string, quote string"


def test_one_shuffle_and_one_sort(spark):
    relations = spark.createDataFrame([("a", "b", "B", "references", "q")], RELATION)
    plan = graph.build_edges(relations, "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count(" Sort ") == 1 and "Join" not in plan, plan


def test_densities_and_reverses(spark):
    rng = random.Random(5)
    ends = [f"n{i}" for i in range(6)] + [None]
    rows = [(rng.choice(ends), rng.choice(ends), rng.choice("ABC"), rng.choice(["references", "depends_on", "hierarchy"]), rng.choice("xyz")) for _ in range(120)]
    rows = [r for r in rows if r[0] or r[1]] + [("h1", "h2", "H", "references", "x")] * 500
    want = {}
    pair = lambda s, t: frozenset((s or t, t or s))
    for s, t, name, kind, quote in rows:
        old = want.get((s, t, kind), ("", ""))
        want[s, t, kind] = (max(old[0], name), max(old[1], quote))
    density = lambda s, t: sum(pair(*r[:2]) == pair(s, t) for r in rows)
    back = lambda s, t, kind: s == t or sum(k[2] == kind and pair(*k[:2]) == pair(s, t) for k in want) == 2
    found = graph.build_edges(spark.createDataFrame(rows + [(None, None, "A", "references", "x")], RELATION).repartition(5), "w")
    found = found.where("source_id IS NOT NULL AND target_id IS NOT NULL").collect()
    got = {(r["source_id"], r["target_id"], r["relation_type"]): (r["target_name"], r["quote"], r["density_count"], r["has_reverse"]) for r in found}
    assert got == {k: (*v, density(*k[:2]), back(*k)) for k, v in want.items() if k[0] and k[1]}
    assert len(got) == len(found)
