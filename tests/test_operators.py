import datetime
import json

import pytest
from pyspark.sql import functions as F

from corvia import schemas
from corvia.operators import capsule, cases, catalog, graph, ranking, retrieval, scope, state, sync
from corvia.operators.state import NotFound
from corvia.plans import knowledge


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rrf(spark):
    lists = spark.createDataFrame([(0, i, d, r) for i, docs in enumerate((["a", "b", "c"], ["b", "a", "d"])) for r, d in enumerate(docs, 1)], "query_id int, list int, id string, rank int")
    found = {r["id"]: r["score"] for r in retrieval.rrf(lists).collect()}
    assert found["a"] == found["b"] == pytest.approx(1 / 61 + 1 / 62) and found["c"] == found["d"] == pytest.approx(1 / 63)


def test_fusion_counts_repeats_and_boosts(spark):
    hits = spark.createDataFrame([("q", "source", "a", "exact", None, None, 1, "high", "active"), ("q", "source", "b", "dense", None, None, 2, "low", "stale"), ("q", "source", "b", "dense", None, None, 3, "low", "stale"), ("q", "concept", "c", "graph", "g", 5.0, 4, "medium", "active")], "query_id string, kind string, id string, channel string, ranking string, raw_score double, ord long, confidence string, status string")
    found = {r["id"]: r for r in retrieval.fuse_hits(hits).collect()}
    assert found["a"]["score"] == round(1 / 61 + 0.3 + 0.03, 8) and found["a"]["match_confidence"] == "strong"
    assert found["b"]["score"] == round(1 / 61 + 1 / 62, 8) and found["b"]["match_confidence"] == "weak"
    assert found["c"]["score"] == round(1 / 61 + 0.02 + 0.02, 8)


def test_capsule_budget():
    item = lambda i, n: {"id": str(i), "kind": "source", "title": "t", "summary": "s" * n, "score": 1.0, "rank_signals": [], "provenance": [{"path": "p" * 300, "quote_hint": "q"}] * 5, "relationships": []}
    selected, chars = capsule.pack_items([item(i, 5000) for i in range(9)], "micro")
    assert 1 <= len(selected) <= 3 and chars <= 1800 and len(selected[0]["summary"]) == 420
    huge = item(1, 5000) | {"title": "t" * 900, "id": "i" * 900}
    compact, _ = capsule.pack_items([huge], "micro")
    assert compact and len(compact[0]["summary"]) == 120 and len(compact[0]["provenance"]) == 1
    skipped, _ = capsule.pack_items([item(0, 10), item(1, 400) | {"id": "x" * 1700}, item(2, 10)], "micro")
    assert [s["id"] for s in skipped] == ["0", "2"]


def test_scope_needs_values():
    with pytest.raises(ValueError):
        scope.Scope("w", " ", "v1")


def test_schema_migration():
    T = schemas.T
    have = T.StructType([T.StructField("id", T.StringType()), T.StructField("old", T.StringType())])
    want = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert schemas.migration(have, want) == (["n"], ["old"])
    for bad in (T.StructField("s", T.StringType()), T.StructField("v", T.ArrayType(T.FloatType())), T.StructField("id", T.LongType())):
        with pytest.raises(schemas.SchemaMismatch):
            schemas.migration(have, T.StructType([bad]))


def test_state_tables(spark):
    stored = spark.createDataFrame([("a", "active", 1, "x"), ("b", "archived", 2, "y"), ("c", "active", 5, "z")], "id string, lifecycle_state string, revision int, v string")
    patches = spark.createDataFrame([("a", 1, "new"), ("c", 4, "no")], "id string, expected_revision int, v string")
    assert pairs(state.optimistic_update(stored, patches, ["id"]), "id", "v", "revision", "outcome") == [("a", "new", 2, "updated"), ("b", "y", 2, "kept"), ("c", "z", 5, "conflict")]
    gone = spark.createDataFrame([("a", 1), ("b", 2)], "id string, expected_revision int")
    assert pairs(state.archive(stored, gone, ["id"]), "id", "lifecycle_state", "outcome") == [("a", "archived", "updated"), ("b", "archived", "conflict"), ("c", "active", "kept")]
    assert pairs(state.delete(stored, gone, ["id"]), "id") == [("c",)]
    assert pairs(state.upsert(stored, stored.limit(0).union(spark.createDataFrame([("a", "q", 9, "w"), ("d", "q", 1, "w")], stored.schema)), ["id"]), "id", "v") == [("a", "w"), ("b", "y"), ("c", "z"), ("d", "w")]
    assert pairs(state.patch(stored, spark.createDataFrame([("a", "p"), ("b", None)], "id string, v string"), ["id"]), "id", "v") == [("a", "p"), ("b", "y"), ("c", "z")]
    with pytest.raises(ValueError):
        state.conditional_update(stored, patches.withColumn("expected_status", F.lit("x")), ["id"], ["other"])
    assert pairs(state.counters(spark.createDataFrame([("k", "7"), ("m", "x")], "key string, value string"), spark.createDataFrame([("k",), ("m",), ("n",)], "key string")), "key", "value") == [("k", 7), ("m", None), ("n", None)]


def test_all_rows_of_a_duplicate_go(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    assert pairs(state.reject_duplicates(rows, F.col("id")), "n") == [(3,)]


def test_sync_operations(spark):
    parsed = spark.createDataFrame([("same", "u", "h", "f"), ("new", "u", "h", "f"), ("moved", "u2", "h", "f"), ("edited", "u", "h", "f"), ("changed", "u", "h2", "f")], "document_id string, canonical_uri string, content_hash string, file_hash string")
    old = spark.createDataFrame([(d, "u", "h", "f", 0) for d in ("same", "moved", "edited", "changed")] + [("gone", "u", "h", "f", 0), ("long_gone", "u", "h", "f", 2)], "document_id string, canonical_uri string, content_hash string, file_hash string, missing_count int")
    files = spark.createDataFrame([(d, "f", False) for d in ("same", "moved", "changed", "gone")] + [("edited", "x", False)], "document_id string, current_hash string, same_content boolean")
    decided = sync.decide(parsed, old, files)
    assert pairs(decided, "document_id", "operation", "missing_count") == [("changed", "updated", 0), ("edited", "restored", 0), ("gone", "missing", 1), ("long_gone", "archived_candidate", 3), ("moved", "moved", 0), ("new", "added", 0), ("same", "unchanged", 0)]
    assert dict(pairs(sync.decide(parsed, old, files, overwrite=False), "document_id", "operation"))["edited"] == "failed"
    gates = sync.gates(sync.run_stats(decided)).first()
    assert gates["large_change"] and gates["may_apply"]
    assert sync.next_state(sync.decide(parsed, old, files, overwrite=False), old).count() == 7


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("x", "y")], "source string, target string")
    assert pairs(sync.crawl(links, spark.createDataFrame([("a",)], "uri string"), 10), "uri", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert sync.crawl(links, spark.createDataFrame([("a",)], "uri string"), 3).count() == 3


def test_paths(spark):
    docs = spark.createDataFrame([("d1", None, "x/a.md"), ("d2", "x/a.md", "y/b.md"), ("d3", None, "z.md")], "document_id string, state_path string, proposed_path string")
    found = dict(pairs(sync.choose_paths(docs), "document_id", "path"))
    assert found["d2"] == "x/a.md" and found["d3"] == "z.md" and found["d1"].startswith("x/a-d1-")
    refs = lambda rows: spark.createDataFrame(rows, "document_id string, title string, metadata map<string,string>")
    merged = sync.merge_refs(refs([("a", "old", {"x": "1", "y": "1"})]), refs([("a", None, {"y": "2"}), ("b", "new", {})])).orderBy("document_id").collect()
    assert merged[0]["title"] == "old" and merged[0]["metadata"] == {"x": "1", "y": "2"} and merged[1]["title"] == "new"


def test_publish(spark):
    pointers = spark.createDataFrame([("artifact", "a", "r1")], "kind string, id string, revision_id string")
    source = spark.createDataFrame([("s", "sr1", "h")], "source_id string, source_revision_id string, content_hash string")
    artifacts = spark.createDataFrame([("a", "r2"), ("b", "r3")], "artifact_id string, artifact_revision_id string")
    staged = catalog.stage("op", source, artifacts, 4)
    moved, revision = catalog.publish(staged, pointers, 4)
    assert revision == 5 and pairs(moved, "id", "revision_id") == [("a", "r2"), ("b", "r3"), ("s", "sr1")]
    again, same = catalog.publish(staged, moved, 5)
    assert same == 5 and again.count() == 3
    with pytest.raises(catalog.Conflict):
        catalog.publish(staged, pointers, 6)
    assert {r["state"] for r in catalog.abandon(staged, moved, "late").collect()} == {"published"}
    with pytest.raises(NotFound):
        catalog.active(spark.createDataFrame([("a", "lost")], "artifact_id string, artifact_revision_id string"), artifacts, strict=True)


EVIDENCE = {f.name: None for f in schemas.EVIDENCE}


def draft(**more):
    base = {f.name: None for f in schemas.DRAFT} | {"artifact_type": "concept", "wiki_id": "w", "namespace": "n", "version": "v", "canonical_name": "Add", "aliases": ["plus"], "claims": [], "related_artifacts": [], "open_questions": []}
    return base | more


def claim(text, confidence, *evidence):
    return {"text": text, "confidence": confidence, "evidence": [EVIDENCE | e for e in evidence]}


def test_merges_and_items(spark):
    own = spark.createDataFrame([(draft(),)], schemas.T.StructType([schemas.field("draft", schemas.DRAFT)]))
    same = own.select(catalog.artifact_id(F.lit("w"), F.lit("n"), F.lit("v"), F.lit("concept"), F.lit("Add"))).first()[0]
    known = spark.createDataFrame([(same, 3)], "artifact_id string, revision_number int")
    assert pairs(catalog.plan_merges(own, known), "action", "revision_number") == [("updated", 4)]
    assert pairs(catalog.plan_merges(own, known.limit(0)), "action", "revision_number") == [("created", 1)]
    assert pairs(catalog.plan_merges(own, known.union(known)), "action") == [("needs_review",)]
    apart = spark.createDataFrame([(draft(merge_recommendation={"action": "keep_separate", "target_artifact_id": None, "reason": None}),)], own.schema)
    assert pairs(catalog.plan_merges(apart, known), "action") == [("needs_review",)]
    both = spark.createDataFrame([(draft(aliases=["a", "b"], title="old"), draft(aliases=["b", "c"], title="new"))], schemas.T.StructType([schemas.field("x", schemas.DRAFT), schemas.field("y", schemas.DRAFT)]))
    merged = both.select(catalog.merge_drafts(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert merged["aliases"] == ["a", "b", "c"] and merged["title"] == "new"
    e = {"document_id": "d", "rag_collection_id": "c", "part_id": "p"}
    artifact = spark.createDataFrame([({"artifact_id": "a", "artifact_revision_id": "r", "wiki_id": "w", "revision_number": 1, "status": "active", "draft": draft(claims=[claim("one", "high", e | {"path": "1"}), claim("two", "medium", e | {"path": "2"})]), "source_ids": []},)], schemas.T.StructType([schemas.field("a", schemas.ARTIFACT)]))
    item = artifact.select(catalog.knowledge_item(F.col("a")).alias("i")).first()["i"]
    assert item["confidence"] == "medium" and item["content"] == "one\ntwo" and [p["path"] for p in item["provenance"]] == ["2"] and item["rag_collection_ids"] == ["c"]
    assert artifact.select(catalog.index_text(F.col("a.draft"))).first()[0] == "Add\nplus\none\ntwo"


def test_validation(spark):
    part = lambda i, parent, order: {"part_id": i, "parent_part_id": parent, "order": order, "heading_path": [], "content": "0123456789"}
    document = {f.name: None for f in schemas.SOURCE_DOCUMENT}
    rows = [document | {"document_id": "ok", "content_hash": "h", "parts": [part("a", None, 1), part("b", "a", 2)]}, document | {"document_id": "bad", "parts": [part("a", "b", 1), part("b", "a", 1), part("b", "x", 3)]}, document | {"document_id": "none", "parts": []}]
    documents = spark.createDataFrame(rows, schemas.SOURCE_DOCUMENT)
    assert pairs(catalog.part_topology_issues(documents), "document_id", "issue") == [("bad", i) for i in ("DUPLICATE_PART_ID", "PART_CYCLE", "PART_ORDER_NOT_INCREASING", "UNKNOWN_PARENT_PART")]
    good = {"document_id": "ok", "part_id": "a", "content_hash": "h", "char_start": 0, "char_end": 5}
    claims = [claim("x", "high", good), claim(" ", "low"), claim("y", "low", {"document_id": "no", "char_start": 3}, good | {"char_end": 99, "namespace": "other"})]
    drafts = spark.createDataFrame([("d", "ok", draft(claims=claims)), ("e", "ok", draft(claims=[claim("x", "high", good)]))], schemas.T.StructType([schemas.field("draft_id", schemas.S), schemas.field("document_id", schemas.S), schemas.field("draft", schemas.DRAFT)]))
    issues = catalog.evidence_issues(drafts, documents)
    assert pairs(issues, "issue") == [(i,) for i in ("CLAIM_WITHOUT_EVIDENCE", "CLAIM_WITHOUT_TEXT", "EVIDENCE_OF_OTHER_DOCUMENT", "HALF_OPEN_RANGE", "NAMESPACE_MISMATCH", "RANGE_BEYOND_PART", "UNKNOWN_DOCUMENT")]
    summary = catalog.validation_summary(drafts, issues)
    assert pairs(summary, "draft_id", "passed") == [("d", False), ("e", True)]
    assert catalog.provenance_coverage(summary).first()[0] == 0.0 and catalog.provenance_coverage(summary.limit(0)).first()[0] == 1.0
    revisions = spark.createDataFrame([("d", "pending_review"), ("e", "pending_review"), ("f", "active")], "artifact_revision_id string, status string")
    decisions = spark.createDataFrame([("d", True), ("e", True), ("f", False)], "artifact_revision_id string, approve boolean")
    assert pairs(catalog.decide_reviews(revisions, decisions, issues), "artifact_revision_id", "status", "outcome") == [("d", "pending_review", "rejected_by_validation"), ("e", "active", "decided"), ("f", "active", "conflict")]


def test_graph(spark):
    relations = spark.createDataFrame([("a", "b", "m.b", "depends_on", "必须"), ("b", "a", "m.a", "depends_on", ""), ("a", "a", "a", "sibling", "x"), ("a", "c", "c", "references", "参见")], "source_id string, target_id string, target_name string, relation_type string, quote string")
    edges = graph.build_edges(relations, "w").cache()
    by = {(r["source_id"], r["target_id"]): r for r in edges.collect()}
    assert by["a", "b"]["reverse_edge_id"] == by["b", "a"]["edge_id"] and by["a", "b"]["density_count"] == 2 and by["a", "a"]["has_reverse"] and not by["a", "c"]["has_reverse"]
    grown = graph.expand(edges, spark.createDataFrame([("a",)], "seed_id string"), spark.createDataFrame([("b",), ("c",)], "artifact_id string"), 5).collect()
    assert [r["target_id"] for r in grown] == ["b", "c"] and grown[0]["relations"][0]["relation"] == "depended_on_by"
    assert graph.export_batches(edges.limit(0), 10).collect()[0]["payload"] == "[]"
    batches = graph.export_batches(edges, 3).orderBy("batch").collect()
    assert [(b["edges"], b["is_last"]) for b in batches] == [(3, False), (1, True)] and len(json.loads(batches[0]["payload"])) == 3
    changed = graph.upsert_artifacts(edges, relations.where("source_id = 'a'").union(relations.where("source_id = 'a'")), spark.createDataFrame([("a",)], "artifact_id string"), "w")
    assert changed.count() == 4
    assert graph.delete_for(edges, spark.createDataFrame([("c",)], "artifact_id string")).count() == 3
    assert graph.export_graph(edges).count() == 3 + 4
    assert [r["edge_id"] for r in graph.outgoing(edges, F.lit("a"), 1).collect()] == [by["a", "b"]["edge_id"]]


def test_pages_and_ranks(spark):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("t"))
    found = ranking.blocked_rank(rows, F.floor(F.col("id") / 10), [F.col("id")]).collect()
    assert all(r["id"] == r["rank0"] for r in found)
    first = ranking.keyset_page(rows, "t", "id", 5).collect()
    after = ranking.keyset_page(rows, "t", "id", 5, (first[4]["t"], first[4]["id"])).collect()
    assert len(first) == 6 and (after[0]["t"], after[0]["id"]) == (first[5]["t"], first[5]["id"])
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    cursor = spark.createDataFrame([(now, "k|1")], "t timestamp, k string").select(ranking.decode_cursor(ranking.encode_cursor(F.col("t"), F.col("k"))).alias("c")).first()["c"]
    assert (cursor["time"], cursor["key"]) == (now, "k|1")
    assert ranking.top(rows, 0, F.col("id")).count() == 0


def test_cases(spark):
    records = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3), ("p", 4)], "question string, ord int")
    done = spark.createDataFrame([("q", 10, 200), ("q", 200, 200)], "question string, output_length int, output_limit int")
    assert pairs(cases.pending(records, done), "ord", "next_limit") == [(2, 500), (3, 200), (4, 200)]
    assert pairs(cases.unexpected(records, done.union(spark.createDataFrame([("z", 1, 2)], done.schema))), "question", "extra") == [("z", 1)]
    groups = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d", "e"])], "group_id int, files array<string>")
    used = spark.createDataFrame([("a",)], "filename string")
    assert {r["group_id"] for r in cases.pick_comparison(groups, used, 3).collect()} == {2}
    docs = spark.createDataFrame([(f, "m" if f < "c" else "k") for f in "abcde"], "filename string, module string")
    assert cases.pick_single(docs, used, 1).first()["filename"] != "a"
    assert [r["priority"] for r in cases.related(docs, groups, "a", 4, 1).collect()] == [0, 2, 2, 2]
    assert cases.allocate(docs, 3, 1).where("round not between 0 and 2").count() == 0
    missing = cases.identity_missing(spark.createDataFrame([("x", " ")], "a string, b string"), ["a", "b"]).first()["missing"]
    assert missing == ["b"]


def test_knowledge_query(spark):
    rows = [("a1", "concept", "w", "n", "v", "Add", ["plus"], "Add", "adds things", "high", "active"), ("a2", "concept", "w", "n", "v", "Sub", ["minus"], "Sub", "undo of add", "low", "active"), ("a3", "concept", "w", "other", "v", "Add", [], "Add", "", "high", "active"), ("a4", "concept", "w", "n", "v", "Old", [], "Old", "", "high", "archived")]
    artifacts = spark.createDataFrame(rows, "artifact_id string, artifact_type string, wiki_id string, namespace string, version string, canonical_name string, aliases array<string>, title string, summary string, confidence string, status string")
    edges = graph.build_edges(spark.createDataFrame([("a1", "a2", "Sub", "references", "参见")], "source_id string, target_id string, target_name string, relation_type string, quote string"), "w")
    where = scope.Scope("w", "n", "v")
    answer = knowledge.query_knowledge(artifacts, edges, "add", where)
    assert [(r["id"], r["match_confidence"]) for r in answer.ranked.orderBy("rank").collect()] == [("a1", "strong"), ("a2", "moderate")]
    assert not answer.abstained and answer.capsule.first()["selected"] == 2
    none = knowledge.query_knowledge(artifacts, None, "nothing", where)
    assert none.abstained and none.warnings == ["RELATION_READER_UNAVAILABLE", "NO_RESULTS"]
    alias = knowledge.query_knowledge(artifacts, edges, "PLUS", where)
    assert alias.ranked.orderBy("rank").first()["rank_signals"] == ["alias", "lexical"]
    index = spark.createDataFrame([("gone", "w", "n", "v", 1, 0.5), ("kept", "w", "x", "v", 1, 0.5)], "id string, wiki_id string, namespace string, version string, token_id int, weight double")
    rebuilt, problems = knowledge.reindex(artifacts, index, where)
    assert {r["id"] for r in rebuilt.select("id").distinct().collect()} == {"a1", "a2", "kept"}
    assert pairs(problems, "id", "problem") == [("a1", "missing"), ("a2", "missing"), ("gone", "orphan")]
