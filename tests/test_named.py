"""Functions of the inventory, each by its name and what it has to give."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from corvia import schemas
from corvia.functions import markdown as md
from corvia.functions import packages, pages
from corvia.functions import text as t
from corvia.operators import capsule, cases, catalog, graph, ranking, scope, state, sync
from corvia.plans import knowledge
from corvia.sources import api_documents as api
from corvia.sources import connectors, files


def one(spark, column, **values):
    kind = lambda v: "string" if v is None or isinstance(v, str) else "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "array<string>"
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(column).first()[0]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_rows_by_key(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    assert rows(state.fetch(table, "id", "b"), "n") == [(2,)] and state.fetch(table, "id", "z").count() == 0
    assert rows(state.fetch_many(table, spark.createDataFrame([("a",), ("c",), ("z",), ("a",)], "id string"), "id"), "n") == [(1,), (3,)]
    assert rows(state.duplicate_keys(table.union(table.where("n = 1")), F.col("id")), "key", "n") == [("a", 2)]
    assert rows(files.keys_with_prefix(table.select(F.concat(F.lit("p%"), "id").alias("key"), "n"), "p%"), "n") == [(1,), (2,), (3,)]
    good, bad, counts = state.split_valid(table, F.when(F.col("n") > 2, "large"))
    assert rows(good, "id") == [("a",), ("b",)] and rows(bad, "id", "problem") == [("c", "large")] and tuple(counts.first()) == (2, 1)


def test_identities(spark):
    assert one(spark, t.title_api_name(F.col("n"), F.col("s"), F.col("t")), n="Add", s="com.x", t="Add com.x sums  ") == "sums"
    assert one(spark, t.version_of_namespace(F.col("s")), s="com.x.v1") == "v1" and one(spark, t.version_of_namespace(F.col("s")), s=None) == ""
    assert [one(spark, t.default_namespace_segment(F.col("s"), {"Known": "k"}), s=x) for x in ("Known", "My Lib-2", "附录")] == ["k", "my_lib_2", "unknown"]
    assert one(spark, t.normalized_api_name(F.col("s")), s="Add_2<T>(int a)") == "add_2t"
    assert one(spark, t.hit_key("hit", F.col("c"), F.col("a")), c="docs", a="x:y") == "hit:docs:x:y"
    assert one(spark, t.labelled_source_url(F.col("s")), s="> 来源: https://h/a\n") == "https://h/a" and one(spark, t.labelled_source_url(F.col("s")), s="source: https://h/a\nsource: https://h/b") is None
    assert one(spark, t.semantic_text(F.col("s")), s="> 来源: x\n# A **b** [c](d)\n") == "Abc"
    assert one(spark, t.safe_id_fragment(F.col("s")), s="a/b c").startswith("a_b_c-") and one(spark, t.safe_id_fragment(F.col("s")), s="///").startswith("document-")
    assert [one(spark, t.next_output_limit(F.col("n"), F.col("m")), n=n, m=m) for n, m in ((200, 200), (500, 500), (1500, 1500), (10, 200))] == [500, 1500, None, None]
    assert one(spark, t.namespace_of_path(F.col("p"), F.col("v"), "API参考", "com.x", {"SIMD": "simd"}), p="a/API参考/SIMD/b.md", v="v1") == "com.x.simd.v1"
    assert one(spark, t.namespace_of_path(F.col("p"), F.col("v"), "API参考", "com.x"), p="a/b.md", v="v1") is None
    found = one(spark, t.authoritative_hints({"category": F.lit(None).cast("string")}, F.col("p"), F.col("m"), F.col("u"), r"/v(\d+)/", "ref", "com.x", {"SIMD": "cpp"}, {"structs": "struct"}, {"SIMD": "com.simd"}), p="ref/SIMD/structs/a.md", m="# Add(int)\ntext", u="https://h/v7/a.html")
    assert found.asDict() == {"name": "Add(int)", "version": "7", "language": "cpp", "namespace": "com.simd.7", "category": "struct", "chunk_id": "com.simd.7.add"}
    other = one(spark, t.authoritative_hints({}, F.col("p"), F.col("m"), F.col("u"), r"/v(\d+)/", "ref", "com.x"), p="ref/Utils/a.md", m="no heading", u=None)
    assert other["namespace"] == "com.x.utils" and other["name"] is None and other["chunk_id"] is None


def test_markdown_parts(spark):
    assert one(spark, md.junk_path(F.concat(F.lit("a/"), F.lit(md.JUNK_DIRECTORIES[0]), F.lit("/b.md")))) is True and one(spark, md.junk_path(F.lit("a/b.md"))) is False
    assert one(spark, md.signature_of(F.lit(" "), F.col("b")), b="#### Function Prototype\nint f()\n") == "int f()" and one(spark, md.signature_of(F.lit("x"), F.lit(""))) == "x"
    assert md.masked("a `b![x](y)` c\n```\n![z](w)\n```\n").count("![") == 0
    assert one(spark, md.without_links(F.col("s")), s="![a](b) [c](d)") == " c"
    assert one(spark, md.evidence_in(F.col("v"), F.col("m")), v="two  Words", m="has TWO words") is True and one(spark, md.evidence_in(F.lit(" "), F.lit("x"))) is False
    assert one(spark, md.signatures_column(F.col("s")), s="```cpp\nint Add(int a,\n  int b);\nvoid Sub(int c) {\n```\n") == ["Add", "Sub"]
    found = md.blocks(spark.createDataFrame([(1, "# Example\n```c\nx\n```\n# Other\n```\ny\n```\n")], "id int, text string"), ["id"])
    assert rows(md.example_blocks(found), "body") == [("x",)]
    assert one(spark, files.shallow(F.col("s"), 3), s="a\n## Example\nb") == "a" and one(spark, files.shallow(F.col("s"), 2), s="a\nb\nc") == "a\nb"
    docs = spark.createDataFrame([("m/a.md", "# Title\nText here.\n```\nint Add(int a);\n```\n")], "path string, text string")
    found = files.summaries(docs).first()
    assert (found["filename"], found["module"], found["apis"]) == ("a.md", "m", ["Add"]) and found["summary"].startswith("Title Text here.")


def test_yaml_parts(spark):
    assert api.unwrap({"value": 1, "is_ai": True}) == 1 and api.unwrap({"value": 1}) == {"value": 1}
    assert [api.signature_text(x) for x in ("s", {"code": "c"}, [{"code": "d"}, "e"], None, [])] == ["s", "c", "d", "", ""]
    assert api.parameters_markdown([{"name": "a|b", "type": "int", "description": "x\ny"}]).split("\n")[2] == "| a\\|b | int | x y |" and api.parameters_markdown([]) == ""
    use = {"category": {"value": "function", "is_ai": False}, "description": {"value": "adds", "is_ai": True}, "summary": "sum", "product_support": [{"product": "P", "supported": True}, {"product": "Q", "supported": False}], "prerequisites": [], "function_details": {"input_parameters": [{"name": "a", "type": "int", "description": ""}], "output_parameters": [], "signature": {"value": "int Add(int a)", "is_ai": False}}, "data_structure": {"fields": []}, "examples": [{"value": "Add(1)", "is_ai": False}]}
    record = api.nested_record({"name": "Add", "namespace": "com.x", "version": "v1", "language": "cpp", "use": use}, {"source_url": "u"})
    assert record["id"] == "com.x.v1.Add" and record["version_support"] == ["P"] and "#### Signature\nint Add(int a)" in record["body"] and record["examples"] == ["Add(1)"]
    with pytest.raises(ValueError):
        api.nested_record({"name": "", "namespace": "n", "version": "v", "use": use}, {})
    flat = api.flat({"name": "Add(int)", "namespace": "com.x", "version": "v1", "returns": {"value": "int", "is_ai": False}, "examples": [{"code": "e"}, ""]}, {}, "2.0")
    assert flat["id"] == "com.x.v1.add" and json.loads(flat["returns_json"]) == "int" and flat["examples"] == ["e"]
    frame = spark.createDataFrame([("d", "an", None, "i", "sig", [("P", True), ("Q", False), ("", True)])], "description string, api_name string, name string, api_id string, signature string, products array<struct<product:string,supported:boolean>>")
    assert tuple(frame.select(api.dense_text(), api.sparse_text(), api.supported_products(F.col("products"))).first()) == ("d an", "i sig", ["P"])
    assert one(spark, api.stable_document_id(F.lit("path"), F.col("p")), p="x").startswith("yaml:")
    schemas.assert_compatible(schemas.EDGE, schemas.EDGE)
    with pytest.raises(schemas.SchemaMismatch):
        schemas.assert_compatible(schemas.EDGE, schemas.T.StructType(schemas.EDGE.fields[1:]))


def test_graph_and_revisions(spark):
    stored = spark.createDataFrame([("e1", 0.5, "a"), ("e2", 0.6, "b")], "edge_id string, strength_score double, source_id string")
    fresh = spark.createDataFrame([("e1", 0.9, "c"), ("e3", 0.1, "d")], stored.schema)
    assert rows(graph.upsert_edges(stored, fresh), "edge_id", "source_id") == [("e1", "c"), ("e2", "b")]
    assert rows(graph.listed(stored, 0.55), "edge_id") == [("e2",)]
    revisions = spark.createDataFrame([("r1", "x")], "artifact_revision_id string, v string")
    assert rows(catalog.insert_revisions(revisions, spark.createDataFrame([("r1", "other"), ("r2", "y"), ("r2", "y")], revisions.schema)), "artifact_revision_id", "v") == [("r1", "x"), ("r2", "y")]
    assert rows(catalog.pending_reviews(spark.createDataFrame([("a", "pending_review"), ("b", "active")], "id string, status string")), "id") == [("a",)]
    assert one(spark, catalog.ordered_union(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == ["x", "y", "z"]
    sources = spark.createDataFrame([("a", "h", "f"), ("b", "h", "f"), ("c", "h2", "f"), ("d", "h", "f2")], "source_id string, content_hash string, fingerprint string")
    known = spark.createDataFrame([(s, "h", "f") for s in "acd"], sources.schema)
    assert rows(catalog.updates_due(sources, known), "source_id", "outcome") == [("a", "unchanged"), ("b", "created"), ("c", "updated"), ("d", "updated")]
    assert rows(knowledge.update_knowledge(sources, known)[1], "outcome", "n") == [("created", 1), ("unchanged", 1), ("updated", 2)]
    sections = spark.createDataFrame([("d", "n", "v", " Add ", "It adds.\nMore")], "document_id string, namespace string, version string, title string, body string")
    made = knowledge.extract_artifacts(sections).first()
    assert made["canonical_name"] == "Add" and made["claims"][0]["text"] == "It adds."
    values = spark.createDataFrame([([("a", 1), ("a", 2), ("b", 3)],)], "v array<struct<k:string,n:int>>")
    assert [x["n"] for x in values.select(catalog.unique_by(F.col("v"), "k")).first()[0]] == [1, 3] and [x["n"] for x in values.select(catalog.unique_by(F.col("v"), "k", last=True)).first()[0]] == [2, 3]
    assert one(spark, catalog.compiler_fingerprint(*[F.lit(x) for x in ("v1", "v1", "m", "1")])) == __import__("hashlib").sha256(b"v1\x1fv1\x1fm\x1f1").hexdigest()
    extractions = spark.createDataFrame([("a", "v1", "v1", "m"), ("b", "v2", "v1", None)], "document_id string, extractor_version string, prompt_version string, model string")
    assert rows(catalog.extraction_metadata_issues(extractions, "v1", "v1", "m"), "document_id", "issue") == [("b", "EXTRACTOR_VERSION_MISMATCH"), ("b", "MODEL_MISMATCH")]


def test_merged_drafts_keep_one_edge(spark):
    relation = lambda target, quote: {"relation_type": "references", "target_wiki_id": "w", "target_namespace": "n", "target_version": "v", "target_canonical_name": target, "evidence": [{f.name: quote if f.name == "quote_hint" else None for f in schemas.EVIDENCE}], "strength_score": None}
    base = {f.name: None for f in schemas.DRAFT} | {"artifact_type": "concept", "wiki_id": "w", "namespace": "n", "version": "v", "canonical_name": "Add"}
    old, new = base | {"related_artifacts": [relation("B", "old")]}, base | {"title": "new", "related_artifacts": [relation("B", "new"), relation("C", "x"), relation("C", "y")], "merge_recommendation": None}
    frame = spark.createDataFrame([(old, new)], schemas.T.StructType([schemas.field("x", schemas.DRAFT), schemas.field("y", schemas.DRAFT)]))
    merged = frame.select(catalog.merge_drafts(F.col("x"), F.col("y")).alias("m")).first()["m"]
    assert [(r["target_canonical_name"], r["evidence"][0]["quote_hint"]) for r in merged["related_artifacts"]] == [("B", "old"), ("C", "x")] and merged["title"] == "new"
    incoming = frame.select(F.col("y").alias("draft"), F.lit("s2").alias("source_id"))
    own = incoming.select(catalog.artifact_id(F.lit("w"), F.lit("n"), F.lit("v"), F.lit("concept"), F.lit("Add"))).first()[0]
    known = frame.select(F.lit(own).alias("artifact_id"), F.lit(4).alias("revision_number"), F.col("x").alias("draft"), F.array(F.lit("s1")).alias("source_ids"))
    plan = catalog.plan_merges(incoming, known).first()
    assert (plan["action"], plan["status"], plan["revision_number"], plan["source_ids"], len(plan["draft"]["related_artifacts"])) == ("updated", "active", 5, ["s1", "s2"], 2)
    apart = incoming.withColumn("draft", F.col("draft").withField("merge_recommendation", F.struct(F.lit("keep_separate").alias("action"), F.lit(None).cast("string").alias("target_artifact_id"), F.lit(None).cast("string").alias("reason"))))
    kept = catalog.plan_merges(apart, known).first()
    assert (kept["action"], kept["status"], kept["revision_number"], kept["source_ids"]) == ("needs_review", "pending_review", 5, ["s2"])


def test_benchmark_cases(spark):
    problems = spark.createDataFrame([(7, "v1", 3, " ", "s"), (7, "v1", 3, " ", "s"), (8, "v1", 1, "T", "s")], "contest_id int, version string, problem_id int, title string, statement string")
    built = cases.build_cases(problems, "g", "https://h/")
    assert rows(built, "case_id", "source_url", "title") == [("v1/g/7/3", "https://h/7/3", "3"), ("v1/g/8/1", "https://h/8/1", "T")]
    assert built.where("contest_id = 8").select(cases.source_document(built)).first()[0].startswith("---\ncase_id: v1/g/8/1\n")
    contests = spark.createDataFrame([(1, "A", "One"), (2, "B", "Two")], "contest_id int, name string, title string")
    wanted = spark.createDataFrame([("two", 0), ("1", 1), ("a", 2)], "text string, ord int")
    assert [r["contest_id"] for r in cases.select_contests(contests, wanted).collect()] == [2, 1]
    images = spark.createDataFrame([("u", None), ("u", None), ("v", "404"), ("w", "404"), ("x", "timeout")], "url string, reason string")
    assert rows(cases.image_audit(images), "measure", "key", "value") == [("reason", "404", 2), ("reason", "timeout", 1), ("total", "failed", 3), ("total", "occurrences", 5), ("total", "urls", 4)]
    assert [r["url"] for r in cases.failure_examples(images.where("reason IS NOT NULL"), 1, 3).collect()] == ["v", "x", "w"]
    docs = spark.createDataFrame([("a", "", "n"), ("b", "x", None)], "id string, name string, namespace string")
    more = spark.createDataFrame([("a", "N", "zz"), ("b", "no", "ns")], docs.schema)
    assert rows(cases.supplement(docs, more, "id", ["name", "namespace"]), "id", "name", "namespace") == [("a", "N", "n"), ("b", "x", "ns")]
    dealt = cases.allocate(spark.range(100).select(F.concat(F.lit("f"), "id").alias("filename")), 7, 3).groupBy("round").count().collect()
    assert sorted(r["count"] for r in dealt) == [14] * 5 + [15] * 2
    questions = spark.range(5000).select(cases.draw_mode(F.col("id").cast("string"), 1).alias("m")).groupBy("m").count().collect()
    assert 350 < {r["m"]: r["count"] for r in questions}["comparison"] < 650


def test_small_columns(spark):
    assert [one(spark, capsule.next_budget(F.lit(b))) for b in ("micro", "small", "medium", "large")] == ["small", "medium", "large", "large"]
    assert one(spark, ranking.batch_count(F.lit(11), 5)) == 3
    assert [one(spark, sync.final_status(F.lit(f), F.lit(s), F.lit(d))) for f, s, d in ((1, 1, False), (1, 0, False), (0, 3, False), (1, 1, True))] == ["partial", "failed", "succeeded", "dry_run"]
    evidence = spark.createDataFrame([((1, 5),), ((None, None),), ((3, None),), ((5, 5),)], "e struct<char_start:int,char_end:int>")
    assert [r[0] for r in evidence.select(scope.evidence_range_ok(F.col("e"))).collect()] == [True, True, False, False]
    now = datetime.datetime(2024, 1, 10)
    entries = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 9))], "path string, modified timestamp")
    assert rows(sync.retention(entries, 5, F.lit(now)), "path") == [("a",)]
    wait = lambda **more: one(spark, sync.retry_delay(F.lit(3), **more))
    assert wait() == 4.0 and wait(most=3.0) == 3.0 and wait(retry_after=F.lit("7")) == 7.0 and wait(jitter=F.lit(1.0)) == 5.0
    assert wait(retry_after=F.lit("Wed, 10 Jan 2024 00:00:09 GMT"), now=F.lit(now)) == 9.0 and wait(retry_after=F.lit("later")) == 4.0 and wait(retry_after=F.lit("Wed, 10 Jan 2024 00:00:09 GMT"), now=F.lit(datetime.datetime(2025, 1, 1))) == 0.0


def test_files(spark, tmp_path):
    table = spark.createDataFrame([(1, "h")], "page_id int, url string").withColumn("html", F.lit("<p>x"))
    table.write.parquet(str(tmp_path / "pages"))
    assert rows(connectors.stored_pages(spark, {"path": str(tmp_path / "pages")}), "uri", "html") == [("h", "<p>x")]
    files.write_json_lines(table, str(tmp_path / "lines"))
    assert files.json_lines(spark, str(tmp_path / "lines"), table.schema).count() == 1
    made = spark.createDataFrame([("a/b.yaml", "x: 1\n"), ("../c", "x"), ("/d", "x"), ("e", None)], "path string, text string")
    assert rows(files.write_files(made, f"file://{tmp_path}/out").fillna({"error": ""}), "path", "bytes", "error") == [("../c", None, "unsafe path"), ("/d", None, "unsafe path"), ("a/b.yaml", 5, ""), ("e", None, "no text")]
    assert (tmp_path / "out/a/b.yaml").read_text() == "x: 1\n" and not list((tmp_path / "out").rglob("*.tmp"))
    packages_ = spark.createDataFrame([('{"b": "数", "a": [1, null]}',)], "p string").withColumn("y", files.as_yaml(F.col("p")))
    assert packages_.first()["y"] == "b: 数\na:\n- 1\n- null\n"
    checks = packages_.select(files.round_trips(F.col("p"), F.col("y")), files.round_trips(F.col("p"), F.lit("b: 1\nb: 2")), files.round_trips(F.col("p"), F.lit("b: [")))
    assert tuple(checks.first()) == (True, False, False)
    candidates = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    assert [r[0] for r in files.pending_manifest(candidates, candidates.where("path = 'b'")).collect()] == ["a", "c"]
    sources = spark.createDataFrame([("a", "t"), ("b", "t")], "path string, text string")
    h = "sha256:" + __import__("hashlib").sha256(b"t").hexdigest()
    outputs = spark.createDataFrame([("a", "2.1", h, []), ("b", "2.1", "sha256:old", []), ("c", "2.1", h, [])], "path string, schema_version string, content_hash string, issues array<string>")
    assert rows(files.completed(outputs, sources), "path", "done") == [("a", True), ("b", False), ("c", False)]
    assert [one(spark, files.under_roots(F.col("p"), ["/data", "/more/"]), p=p) for p in ("/data/a", "/database/a", "/more/b", "/data/../etc", None)] == [True, False, True, False, False]
    names = files.Aliases({"docs": "/t/docs"}, "docs")
    assert names.resolve(None) == names.resolve("docs") == names.resolve("/t/docs") == "/t/docs"
    with pytest.raises(KeyError):
        names.resolve("other")


def test_untrusted_packages():
    found, problems = packages.normalized({"documents": [{"name": " Add ", "namespace": "n", "kind": "Function", "parameters": ["a", {"name": "b", "direction": "up", "optional": "yes"}], "constraints": "one", "deprecated": "no", "returns": {"b": 1, "a": 2}}]})
    d = found["documents"][0]
    assert (d["name"], d["kind"], d["deprecated"], d["constraints"], d["returns"], d["parameters"][1]["optional"]) == ("Add", "function", False, ["one"], '{"a": 2, "b": 1}', True) and problems == ["direction: up is not allowed"]


# Synchronization


def test_failed_documents_keep_their_state(spark):
    parsed = spark.createDataFrame([("ok", "u", "h", "f")], "document_id string, canonical_uri string, content_hash string, file_hash string")
    old = spark.createDataFrame([(d, "u", "h", "f", n) for d, n in (("ok", 0), ("bad", 1), ("gone", 2), ("other", 0))], "document_id string, canonical_uri string, content_hash string, file_hash string, missing_count int")
    failed, missing = (spark.createDataFrame([(d,) for d in ds], "document_id string") for ds in (["bad", "new"], ["gone", "never"]))
    found = sync.decide(parsed, old, failed=failed, missing=missing)
    assert rows(found, "document_id", "operation", "missing_count") == [("bad", "failed", 1), ("gone", "archived_candidate", 3), ("never", "missing", 1), ("new", "failed", 0), ("ok", "unchanged", 0)]
    assert dict(rows(sync.next_state(found, old), "document_id", "missing_count"))["bad"] == 1
    plain = sync.decide(parsed, old, failed=failed)
    assert dict(rows(plain, "document_id", "operation")) == {"bad": "failed", "gone": "archived_candidate", "new": "failed", "ok": "unchanged", "other": "missing"}


def test_reconcile_prefers_the_path_then_the_oldest(spark):
    schema = "document_id string, canonical_uri string, relative_path string, present boolean, mtime long"
    state_ = spark.createDataFrame([("old1", "u", "a/x.md", True, 5), ("old2", "u", "b/y.md", True, 3), ("alone", "v", "z.md", False, None), ("d1", "w", "p.md", True, 1), ("d2", "w", "q/r.md", True, 9), ("d3", "w", "q/s.md", False, 0)], schema)
    refs = spark.createDataFrame([("u", "new", None), ("w", "d9", "p.md")], "canonical_uri string, document_id string, preferred_path string")
    assert rows(sync.reconcile(state_, refs), "document_id", "relative_path") == [("alone", "z.md"), ("d9", "p.md"), ("new", "b/y.md")]
    assert dict(rows(sync.reconcile(state_, refs.drop("preferred_path")), "document_id", "relative_path"))["d9"] == "q/r.md"
    tied = spark.createDataFrame([("a", "u", "m/b.md", True, 1), ("b", "u", "m/c.md", True, 1)], schema)
    assert rows(sync.reconcile(tied, refs), "relative_path") == [("m/c.md",)]


def test_references(spark):
    local = spark.createDataFrame([("u", "d1", "a.md", ["x"], 9), ("u", "d2", "k/b.md", ["x", "y"], 5), ("u", "d3", "k/c.md", ["x", "Y"], 1), ("v", "d4", "z.md", [], 0)], "canonical_uri string, document_id string, path string, hierarchy array<string>, mtime long")
    refs = sync.bootstrap_refs(local)
    assert rows(refs, "canonical_uri", "relative_path_hint") == [("u", "k/c.md"), ("v", "z.md")]
    labels = sync.hierarchy_labels(spark.createDataFrame([(["A b", "c"],), (["a_B"],), (["a_B", " "],)], "hierarchy array<string>"))
    assert rows(labels, "key", "label") == [("ab", "a_B"), ("c", "c")]
    roots = spark.createDataFrame([("u",), ("n",)], "canonical_uri string")
    assert rows(sync.initial_refs(roots, refs, lambda c: F.concat(F.lit("id:"), c)), "canonical_uri", "document_id") == [("n", "id:n"), ("u", "d3")]
    found = spark.createDataFrame([("d", "x", "a/b.md", 1), ("d", "d", None, 2), ("e", "y", "a.md", 1), ("e", "z", "a/b.md", 2)], "document_id string, ref_id string, relative_path_hint string, ord int")
    assert rows(sync.best_refs(found), "document_id", "ref_id") == [("d", "d"), ("e", "z")]


def test_crawl_to_the_end(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(12)], "source string, target string")
    assert sync.crawl(links, spark.createDataFrame([("n000",)], "uri string"), 1000).count() == 13


def test_journal_and_resume(spark):
    decided = spark.createDataFrame([("a", "added", "ua", "ha", "fa", None), ("b", "updated", "ub", "hb", "fb", "old"), ("c", "unchanged", "uc", "hc", "fc", "fc"), ("d", "moved", "ud", "hd", "fd", "fd"), ("e", "added", "ue", "he", "fe", None)], "document_id string, operation string, new_uri string, new_hash string, new_file string, current_hash string")
    actions = sync.journal(decided, "run1", F.concat("document_id", F.lit(".md")), "/s", "/b")
    assert rows(actions.fillna({"backup_path": ""}), "document_id", "backup_path") == [("a", ""), ("b", "/b/run1/b.md"), ("d", "/b/run1/d.md"), ("e", "")]
    there = spark.createDataFrame([("/s/run1/a.md", "fa"), ("/s/run1/b.md", "fb"), ("b.md", "old"), ("d.md", "fd")], "path string, hash string")
    judged = sync.journal_problems(actions, "run1", "/s", "/b", there)
    assert rows(judged.fillna({"problem": ""}), "document_id", "problem", "settled") == [("a", "", False), ("b", "", False), ("d", "", True), ("e", "staged file is missing", False)]
    other = sync.journal_problems(actions, "run2", "/s", "/b", there)
    assert {r["problem"] for r in other.collect()} == {"staging path is not the run's"}
    state_ = spark.createDataFrame([("b", "ub0", "hb0", "fb0", 0), ("z", "uz", "hz", "fz", 2)], "document_id string, canonical_uri string, content_hash string, file_hash string, missing_count int")
    done, after, documents = sync.resume(actions.withColumn("completed", F.col("document_id") == "d"), state_, judged)
    assert rows(done, "document_id", "completed") == [("a", True), ("b", True), ("d", True), ("e", False)]
    assert rows(after, "document_id", "content_hash", "missing_count") == [("a", "ha", 0), ("b", "hb", 0), ("d", "hd", 0), ("z", "hz", 2)]
    assert rows(documents, "document_id", "operation") == [("a", "added"), ("b", "updated"), ("e", "failed")]
    row = sync.manifest(documents, "run2", "resume").first()
    assert (row["documents"], row["written"], row["failed"], row["status"], row["mode"]) == (3, 2, 1, "partial", "resume")


# Pages and packages

PAGE = """<html><head><title>Add - Math - API</title></head><body><nav class="breadcrumb"><a href="/">Home</a><a href="/m">Maths</a></nav>
<article><h1 id="other">Other</h1><p>Another article that is mounted beside, long enough to be one.</p></article>
<article><h1 id="add">Add</h1><a name="node7"></a><p>Adds <b>two</b> numbers, see <a href="sub.html?x#y">Sub</a>, <a href="#top">top</a>, <a href="http://else/x.html">x</a> and <a href="add.html">itself</a>.</p>
<span class="katex-display"><span class="katex"><math><annotation encoding="application/x-tex">a+b</annotation></math><span class="katex-html">a+b</span></span></span><span class="katex"><span class="katex-html">c</span></span>
<ul><li>one<li>two</ul><table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table><pre>int  x;
y</pre><img src="i.png" alt="pic"><script>no</script><div class="table-expand-btn">open</div></article></body></html>"""


def test_a_page_of_several_articles():
    options = pages.Options(hosts=["h.com"], prefixes=["/doc/"], pattern=r"\.html$")
    found = pages.parse(PAGE, "http://H.com/doc/add.html", options, labels={pages.hierarchy_key("math"): "Math"})
    assert (found["title"], found["hierarchy"], found["external_id"], found["canonical_uri"]) == ("Add", ["Math"], "node7", "http://h.com/doc/add.html")
    assert found["links"] == [("http://h.com/doc/sub.html", "Sub")]
    body = found["markdown"]
    assert "Adds **two** numbers, see [Sub](http://H.com/doc/sub.html?x#y)" in body and "$$\na+b\n$$" in body and "`c`" in body and "- one\n- two" in body and "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |" in body
    assert "```\nint  x;\ny\n```" in body and "![pic](http://H.com/i.png)" in body and "no" not in body.split("\n") and "open" not in body and body.count("# Add") == 1
    assert found["artifact"].startswith("# Add\n\n> Source: http://h.com/doc/add.html\n> Id: `node7`\n\n---\n")
    assert pages.parse(PAGE, "http://h.com/doc/add.html", options)["hierarchy"] == ["Home", "Maths"]
    assert pages.parse(PAGE, "http://h.com/doc/add.html", options, known=["K"], has_path=True)["hierarchy"] == ["K"]
    with pytest.raises(ValueError, match="articles"):
        pages.parse(PAGE, "http://h.com/doc/none.html", options)
    with pytest.raises(ValueError, match="short"):
        pages.parse("<article><h1>T</h1>x</article>", "http://h.com/doc/t.html", options)


def test_table_of_pages(spark):
    frame = spark.createDataFrame([(1, "http://h/add.html", PAGE, 200), (2, "http://h/x.html", PAGE, 404), (3, "http://h/y.html", None, 200), (4, "http://h/z.html", "<article><h1>Z</h1>" + "<div>" * 900 + "deep text of some length</article>", 200)], "id int, uri string, html string, status_code int")
    found = {r["id"]: r for r in pages.parse_pages(frame, ["id"]).collect()}
    assert found[1]["title"] == "Add" and found[1]["links"][0]["uri"] == "http://h/sub.html" and found[2]["error"] == "HTTP 404" and found[3]["error"] == "no article" and found[4]["title"] == "Z" and "deep text" in found[4]["markdown"]


MD = "# Add\n#### Function Prototype\n```cpp\nint Add(int a);\n```\n#### Example\n```cpp\nAdd(1);\n```\nAdds numbers on Chip A. ![pic](http://h/p.png)\n"


def test_packages_of_schema_21(spark):
    package = packages.package_skeleton(MD, "m/Add.md", None, {"namespace": "n", "version": "v"})
    document = package["documents"][0]
    assert document["name"] == "Add" and document["use"]["function_details"]["signature"]["value"] == "int Add(int a)" and [e["value"] for e in document["use"]["examples"]] == ["Add(1);"]
    assert api.issues_of(package) == []
    slots = {p: packages.Slot() for p in packages.SLOTS}
    assert "documents[].use.examples" not in packages.open_slots(package, slots) and "documents[].use.summary" in packages.open_slots(package, slots)
    filled = packages.fill_package(package, {"document_updates": [{"document_index": 0, "name": "Other", "summary": "adds NUMBERS", "description": "not said anywhere", "product_support": [{"product": "Chip A", "supported": True}, {"product": "Chip B", "supported": True}, {"product": "Chip A", "supported": "yes"}], "input_parameters": [{"name": "a", "type": "int", "description": "left"}, {"name": "zz", "type": ""}], "examples": ["replaced"]}, {"document_index": 5}]}, slots)
    use = filled["documents"][0]["use"]
    assert filled["documents"][0]["name"] == "Add" and use["summary"] == {"value": "adds NUMBERS", "is_ai": False} and use["description"]["value"] == "" and [e["value"] for e in use["examples"]] == ["Add(1);"]
    assert use["product_support"] == [{"product": "Chip A", "supported": True, "is_ai": False}] and use["function_details"]["input_parameters"] == [{"name": "a", "type": "int", "description": "left", "is_ai": True}]
    generated = packages.fill_package(package, {"document_updates": [{"document_index": 0, "description": "Not said. Anywhere at all"}]}, {"documents[].use.description": packages.Slot(allow_generate=True, most=12)})
    assert generated["documents"][0]["use"]["description"] == {"value": "Not said.", "is_ai": True}
    images = {p: packages.Slot() for p in packages.IMAGE_SLOTS}
    bare = packages.package_skeleton("![](http://h/p.png) ![](q.png) text of a page", "a.md")
    assert [(i["url"], i["fields"]) for i in packages.images_to_describe(bare, {}, images)] == [("http://h/p.png", ["alt", "title"])]
    told = packages.fill_package(bare, {"image_updates": [{"resource_id": bare["source"]["resources"][0]["resource_id"], "alt": "a chart", "title": "t" * 99}]}, images)
    assert told["source"]["resources"][0]["raw"]["alt"] == {"value": "a chart", "is_ai": True} and len(told["source"]["resources"][0]["raw"]["title"]["value"]) == 40
    request = packages.bounded_request("T", package, {"code_blocks": [{"content": "x" * 9000}]}, slots, 8000)
    assert len(request) < 8100 and "slot_fill_input" in request
    long = packages.package_skeleton(MD + "word " * 4000, "m/Add.md")
    long["documents"] = []
    assert packages.CUT.strip() in json.loads(packages.bounded_request("T", long, {}, slots, 6000).split("\n")[3])["preprocess_markdown"]
    with pytest.raises(ValueError):
        packages.bounded_request("T", package, {}, slots, 1000)
    table = spark.createDataFrame([("m/Add.md", MD, json.dumps({"document_updates": [{"document_index": 0, "summary": "Adds numbers"}]})), ("b.md", "", None), ("c.md", "x", "[1")], "path string, text string, updates string")
    found = {r["path"]: r for r in packages.build_packages(table).collect()}
    assert "documents[].use.summary" not in found["m/Add.md"]["open_slots"] and found["b.md"]["documents"] == 1 and found["c.md"]["error"]


def test_keys_scopes_and_reports(spark):
    stored = spark.createDataFrame([("a", "x")], "id string, name string")
    more = spark.createDataFrame([("a", "n1", 1), ("b", "x", 2), ("c", "n2", 3), ("d", "n2", 4), ("c", "n3", 5), ("e", None, 6), ("f", None, 7)], "id string, name string, ord int")
    assert rows(state.insert_unique(stored, more, [["id"], ["name"]], "ord").fillna({"repeats": -1}), "ord", "status", "repeats") == [(1, "duplicate", 0), (2, "duplicate", 1), (3, "inserted", -1), (4, "duplicate", 1), (5, "duplicate", 0), (6, "inserted", -1), (7, "inserted", -1)]
    edges = spark.createDataFrame([("w", "n", "v", 1), ("w", "n", "v2", 2), ("w", None, "v", 3)], "wiki_id string, namespace string, version string, i int")
    left, gone = scope.clear_scope(edges, scope.Scope("w", "n", "v"))
    assert gone == 1 and rows(left, "i") == [(2,), (3,)]
    report = sync.import_report(spark.createDataFrame([("a", "inserted"), ("c", "failed")], "path string, status string")).first()
    assert (report["files"], report["failed"], report["status"]) == (2, 1, "partial")
    paths = spark.createDataFrame([("u", "a/b.md", False), ("u", "c.md", True), ("v", "d.md", False)], "canonical_uri string, path string, in_state boolean")
    old = spark.createDataFrame([("u", "a/b.md", "h"), ("w", "gone.md", "h")], "canonical_uri string, relative_path string, content_hash string")
    assert rows(sync.rebuilt_state(old, paths), "canonical_uri", "relative_path") == [("u", "c.md")]
    cursors = spark.createDataFrame([("nonsense",)], "c string")
    assert cursors.select(ranking.decode_cursor(F.col("c"))["time"]).first()[0] is None
    with pytest.raises(Exception, match="no cursor"):
        cursors.select(ranking.decode_cursor(F.col("c"), strict=True)).collect()
    assert md.preprocess(r"a $x\_1 [b](c)$ \_ [d](e)" + "\n---footer\nmore", footer="---footer") == r"a $x\_1 [b](c)$ _ d"
    assert one(spark, md.minimal_unit(F.lit("x"), F.col("s"), titles_out=["All"])["reason"], s="# All\ntext") == "title" and one(spark, md.minimal_unit(F.lit("x"), F.col("s"), listing=["see below"])["reason"], s="# A\nsee below") == "listing"
    relations = spark.createDataFrame([("a", "b", "m.b", "depends_on", "必须")], "source_id string, target_id string, target_name string, relation_type string, quote string")
    parts = graph.export_graph(graph.build_edges(relations, "w"), {"wiki_id": "w"}).collect()
    assert [p["part"] for p in parts[:2]] == ["scope", "stats"] and json.loads(parts[1]["json"])["edges:all"] == 1 and len(parts) == 5
