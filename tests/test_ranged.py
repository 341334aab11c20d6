import random

import pytest
from pyspark.sql import functions as F

from corvia import schemas
from corvia.operators import retrieval
from corvia.operators.catalog import Conflict
from corvia.operators.scope import Scope
from corvia.plans import knowledge
from corvia.sources.ranged import RangedTable

SCHEMA = "key string, value long"


def frame(spark, rows):
    return spark.createDataFrame([(f"k{k:06}", v) for k, v in rows], SCHEMA)


def held(table, version=None):
    return {int(r["key"][1:]): r["value"] for r in table.read(version).collect()}


def disjoint(table):
    bounds = sorted((f["lo"], f["hi"]) for f in table.files().values())
    return all(a[1] < b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_a_change_rewrites_the_files_of_its_keys(spark, tmp_path):
    table = RangedTable(spark, str(tmp_path), SCHEMA, "key", 100)
    assert table.upsert(frame(spark, [])) == (0, []) and held(table) == {}
    table.upsert(frame(spark, [(2 * i, i) for i in range(5000)]))
    n, want = len(table.files()), {2 * i: i for i in range(5000)}
    assert n > 30 and disjoint(table) and held(table) == want
    # one in a hundred, next to each other
    changes = {k: -k for k in range(4000, 4100)}
    version, touched = table.upsert(frame(spark, changes.items()))
    assert len(touched) <= 4 and version == 2 and held(table) == want | changes and disjoint(table)
    assert held(table, 1) == want
    # far apart, with deletions: files between them stay
    rng, now = random.Random(1), want | changes
    some = rng.sample(sorted(now), 12)
    version, touched = table.upsert(frame(spark, [(k, 7) for k in some]), F.col("key").isin([f"k{k:06}" for k in some[:6]]))
    now = {k: v for k, v in now.items() if k not in some[:6]} | dict.fromkeys(some[6:], 7)
    assert len(touched) <= 12 and held(table) == now and disjoint(table)
    # before, behind and between all that is there
    table.upsert(spark.createDataFrame([("a", 1), ("z", 2)], SCHEMA))
    assert {r["key"] for r in table.between("a", "b").collect()} == {"a"} and disjoint(table)
    assert {int(r["key"][1:]) for r in table.between("k000100", "k000200").collect()} == {k for k in now if 100 <= k < 200}


def test_many_rounds_against_a_dict(spark, tmp_path):
    table, rng, now = RangedTable(spark, str(tmp_path), SCHEMA, "key", 40), random.Random(2), {}
    for r in range(6):
        some = {rng.randrange(1500): r for _ in range(rng.choice([1, 60, 300]))}
        gone = [k for k in some if k % 5 == r % 5]
        table.upsert(frame(spark, some.items()), F.col("key").isin([f"k{k:06}" for k in gone]))
        now = {k: v for k, v in (now | some).items() if k not in gone}
        assert held(table) == now and disjoint(table)
    _, touched = table.replace("k000500", "k000700", frame(spark, [(600, 1)]))
    assert held(table) == {k: v for k, v in now.items() if not 500 <= k < 700} | {600: 1} and disjoint(table)
    assert len(touched) < len(table.files(table.version() - 1))
    with pytest.raises(ValueError):
        table.replace("k000500", "k000700", frame(spark, [(800, 1)]))


def test_the_late_writer(spark, tmp_path):
    one, two = (RangedTable(spark, str(tmp_path), SCHEMA, "key") for _ in range(2))
    one.upsert(frame(spark, [(1, 1)]))
    two.version = lambda: 0  # read before the first commit
    with pytest.raises(Conflict):
        two.upsert(frame(spark, [(1, 2)]))
    assert held(one) == {1: 1}


def artifacts(spark, rows):
    draft = lambda ns, name, text: {"artifact_type": "concept", "wiki_id": "w", "namespace": ns, "version": "v1", "canonical_name": name, "title": name, "aliases": [], "summary": text, "claims": [], "open_questions": [], "related_artifacts": [], "merge_recommendation": None}
    made = [{"artifact_id": a, "artifact_revision_id": f"{a}.{text}", "wiki_id": "w", "revision_number": 1, "status": status, "draft": draft(ns, a, text), "source_ids": []} for a, ns, text, status in rows]
    return spark.createDataFrame(made, schemas.ARTIFACT)


def test_an_index_of_artifacts(spark, tmp_path):
    index = knowledge.ArtifactIndex(spark, str(tmp_path), knowledge.hash_embedding, 20)
    rows = [(f"a{i:03}", f"n{i % 5}", f"some words {i} and more", "active") for i in range(200)]
    index.upsert(artifacts(spark, rows))
    n = len(index.table.files())
    assert n >= 8 and index.table.read().count() == 200
    changed = [("a001", "n1", "other words", "active"), ("a006", "n1", "other texts", "active")]
    _, touched = index.upsert(artifacts(spark, changed))
    assert len(touched) <= 2 and {r["summary"] for r in index.of(Scope("w", "n1", "v1")).where("artifact_id IN ('a001', 'a006')").collect()} == {"other words", "other texts"}
    _, touched = index.remove(spark.createDataFrame([("w", "n1", "v1", "a011")], "wiki_id string, namespace string, version string, artifact_id string"))
    assert len(touched) == 1 and index.table.read().count() == 199
    before = {r["key"]: r for r in index.table.read().where("namespace <> 'n1'").collect()}
    live = artifacts(spark, [(a, ns, t, "pending_review" if a == "a016" else s) for a, ns, t, s in rows])
    _, touched = index.rebuild(live, Scope("w", "n1", "v1"))
    own = {r["artifact_id"]: r for r in index.of(Scope("w", "n1", "v1")).collect()}
    assert len(own) == 39 and "a016" not in own and "a011" in own and len(touched) < n
    assert {r["key"]: r for r in index.table.read().where("namespace <> 'n1'").collect()} == before
    # dense and sparse vectors are those of the scope's own texts
    alone = live.where("draft.namespace = 'n1' AND status = 'active'")
    texts = alone.select("artifact_id", F.concat_ws("\n", "draft.canonical_name", "draft.title", "draft.summary").alias("text"))
    vectors = retrieval.sparse_vectors(texts, "artifact_id", F.col("text"), retrieval.document_frequency(texts, F.col("text")), 39)
    want = {(r["artifact_id"], r["token_id"]): round(r["weight"], 9) for r in vectors.collect()}
    assert {(a, t): round(w, 9) for a, r in own.items() for t, w in r["sparse_embedding"].items()} == want
    assert all(len(r["dense_embedding"]) == 64 for r in own.values())
