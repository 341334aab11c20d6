"""Retrieval beyond the wiki, search in other scripts and with vectors, indexing and answers."""

import pytest
from pyspark.sql import functions as F

from corvia.operators import fallback, graph, retrieval, scope
from corvia.plans import knowledge
from corvia.sources import api_documents

WHERE = scope.Scope("w", "n", "v1")
ARTIFACT = "artifact_id string, artifact_type string, wiki_id string, namespace string, version string, canonical_name string, aliases array<string>, title string, summary string, confidence string, status string"
HIT = "query_id string, document_id string, rag_collection_id string, namespace string, version string, title string, summary string, content string, language string, channel string, raw_score double, source_url string, source_path string, rank int"


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def source(spark, *documents, channel="sparse"):
    return spark.createDataFrame([("q", d, "rag:test", "n", "v1", d, "summary", f"# {d}", "cpp", channel, 0.5, "", f"{d}.md", i) for i, d in enumerate(documents, 1)], HIT)


def wiki(spark, *rows):
    return spark.createDataFrame([(i, "concept", "w", "n", "v1", n, [], n, s, "low", "active") for i, n, s in rows], ARTIFACT)


def test_a_wiki_hit_asks_no_sources(spark):
    answer = knowledge.query_knowledge(wiki(spark, ("a", "Barrier", "")), None, "barrier", WHERE)
    asked = []
    found = knowledge.query_with_fallback(answer, lambda n: asked.append(n), WHERE)
    assert not asked and found.route == "wiki_hit" and found.trace[0]["details"]["route"] == "wiki_hit" and found.sources is None


def test_a_miss_asks_the_sources_and_schedules_an_update(spark):
    answer = knowledge.query_knowledge(wiki(spark, ("a", "Other", "")), None, "barrier", WHERE)
    scheduled, limits = [], []
    found = knowledge.query_with_fallback(answer, lambda n: limits.append(n) or source(spark, "api:barrier", "api:wait"), WHERE, schedule=lambda d: scheduled.extend(d.collect()), warned=("RAG_TEST",))
    assert limits == [20] and found.route == "rag_fallback" and {"RAG_TEST", "LLM_WIKI_MISS_RAG_FALLBACK", "NO_RESULTS"} <= set(found.warnings)
    assert ids(found.ranked, "id", "kind") == [("source:rag:test:api:barrier", "source"), ("source:rag:test:api:wait", "source")]
    assert found.misses.count() == found.requests.count() == 2 and found.capsule.first()["selected"] == 2
    assert sorted(d["document_id"] for d in scheduled) == ["api:barrier", "api:wait"] and scheduled[0]["parts"][0]["content"].startswith("# api")
    recall = next(t for t in found.trace if t["name"] == "recall")
    assert recall["details"]["rag_candidates"] == 2 and {u["area"] for u in found.budget} == {"source_parts", "knowledge_artifacts", "graph_context", "context_packet"}
    assert {r["name"] for r in found.trace_table().collect()} == {"trigger", "recall", "rerank", "inject", "generate"}


def test_a_weak_wiki_item_stays_beside_the_sources(spark):
    answer = knowledge.query_knowledge(wiki(spark, ("a", "Other", "about a barrier")), None, "barrier", WHERE)
    assert answer.abstained
    found = knowledge.query_with_fallback(answer, lambda _: source(spark, "api:x"), WHERE, update_wiki=False)
    assert found.route == "wiki_plus_rag" and ids(found.ranked, "id") == [("a",), ("source:rag:test:api:x",)] and "LLM_WIKI_UPDATE_NOT_CONFIGURED" not in found.warnings
    exact = knowledge.query_with_fallback(answer, lambda _: source(spark, "api:x", channel="exact"), WHERE, update_wiki=False)
    assert not exact.abstained and exact.ranked.orderBy("rank").first()["id"] == "source:rag:test:api:x"


def test_nothing_at_all_and_a_failing_update(spark):
    answer = knowledge.query_knowledge(wiki(spark), None, "barrier", WHERE)
    none = knowledge.query_with_fallback(answer, lambda _: source(spark), WHERE)
    assert none.abstained and none.route == "rag_fallback" and "RAG_NO_RESULTS" in none.warnings and none.reason.startswith("no matching")

    def fail(_):
        raise RuntimeError

    found = knowledge.query_with_fallback(answer, lambda _: source(spark, "api:x"), WHERE, schedule=fail)
    assert "LLM_WIKI_UPDATE_SCHEDULE_FAILED" in found.warnings and found.ranked.count() == 1
    with pytest.raises(ValueError):
        knowledge.query_knowledge(wiki(spark), None, " ", WHERE)


def test_misses_go_by_document(spark):
    hits = source(spark, "a", "b", "b")
    cited = spark.createDataFrame([("q", "w", [("other", "a")])], "query_id string, wiki_id string, provenance array<struct<rag_collection_id:string,document_id:string>>")
    misses = fallback.missing_documents(hits, cited, "w")
    assert ids(misses, "document_id") == [("b",), ("b",)] and ids(fallback.enrichment_requests(hits, misses), "document_id", "namespace") == [("b", "n")]
    assert fallback.missing_documents(hits, cited, "x").count() == 3


def test_source_fields(spark):
    docs = spark.createDataFrame([(1, "", "api", None, "d", "s", "p", "", ["e1", "e2"], "", "cpp"), (2, "api2", "", "nm", "d", "s", "", "", None, "# md", "")], "id long, api_id string, api_name string, name string, description string, signature string, parameters_md string, returns_json string, examples array<string>, source_markdown string, language string")
    found = spark.createDataFrame([("q", 1, 0.5, "dense", 1), ("q", 2, 0.4, "exact", 2)], "query_id string, id long, score double, channel string, rank int")
    rows = {r["document_id"]: r for r in fallback.source_hits(found, docs, "n", "v1", "c").collect()}
    assert rows["1"]["content"] == "s\nd\np\ne1\ne2" and rows["1"]["title"] == "api" and rows["api2"]["content"] == "# md" and rows["api2"]["title"] == "nm" and rows["api2"]["language"] is None
    given = docs.select("id", F.lit("q").alias("query_id"), F.lit(1).alias("rank"), F.coalesce("name", F.lit("x")).alias("name"), F.lit("n").alias("namespace"), F.lit("v").alias("version"), F.lit(0.5).alias("score"))
    assert fallback.agent_documents(given, False).first()["score"] is None
    with pytest.raises(Exception, match="no name"):
        fallback.agent_documents(given.withColumn("name", F.lit(" ")), True).collect()


def test_search_in_chinese(spark):
    docs = spark.createDataFrame([(1, "数据搬运接口"), (2, "矩阵乘法"), (3, "data copy"), (4, "数值")], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "数据"), ("b", "矩阵"), ("c", "copy")], "query_id string, text string")
    found = retrieval.sparse_top_k(docs, queries, 1)
    assert ids(found, "query_id", "id") == [("a", 1), ("b", 2), ("c", 3)]
    df = {r["token"]: r["df"] for r in retrieval.document_frequency(docs, F.col("text")).collect()}
    assert df[" 数"] == 2 and df["数据"] == 1 and df["copy"] == 1
    assert ids(retrieval.hybrid_search(docs, queries, 1), "query_id", "id") == [("a", 1), ("b", 2), ("c", 3)]
    assert retrieval.sparse_top_k(docs, spark.createDataFrame([("z", "nothing")], queries.schema), 3).count() == 0


def test_more_queries_than_a_pass_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"word{i}") for i in range(60)], "query_id long, text string")
    want = ids(retrieval.sparse_top_k(docs, queries, 2), "query_id", "id", "rank")
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", 50)
    assert ids(retrieval.sparse_top_k(docs, queries, 2), "query_id", "id", "rank") == want == [(i, i, 1) for i in range(60)]
    assert ids(retrieval.word_top_k(docs, queries, 1), "query_id", "id") == [(i, i) for i in range(60)]


def test_frequencies_beyond_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 3}") for i in range(30)], "doc_id long, text string")
    vectors = lambda: ids(retrieval.sparse_vectors(docs, "doc_id", F.col("text"), retrieval.document_frequency(docs, F.col("text")), 30).withColumn("weight", F.round("weight", 9)), "doc_id", "token_id", "weight")
    want = vectors()
    monkeypatch.setattr(retrieval, "FEW_TOKENS", 0)
    assert vectors() == want and len(want) == 60


def test_channels_of_a_source_search(spark):
    embed = knowledge.hash_embedding
    docs = spark.createDataFrame([(1, "Add", "api:1", "adds two numbers"), (2, "Sub", "api:2", "takes one number from another"), (3, "Mul", "api:3", "multiplies numbers")], "id long, name string, api_id string, text string").withColumn("dense_embedding", embed(F.col("text")))
    queries = spark.createDataFrame([("n", "Sub"), ("t", "adds numbers")], "query_id string, text string").withColumn("vector", embed(F.col("text")))
    found = {(r["query_id"], r["id"]): r for r in retrieval.source_search(docs, queries, 3).collect()}
    assert found["n", 2]["channel"] == "exact" and found["n", 2]["rank"] == 1 and found["t", 1]["channel"] == "sparse" and found["t", 1]["rank"] == 1
    held = docs.withColumn("namespace", F.lit("n")).withColumn("version", F.lit("v1")).withColumn("language", F.lit("cpp")).withColumn("deprecated", F.lit(False))
    named = knowledge.query_documents(held, queries.drop("vector"), "n", "v1", embed=embed)
    assert {(r["query_id"], r["id"], r["route"]) for r in named.where("rank = 1").collect()} == {("n", 2, "name"), ("t", 1, "semantic")}
    asked = spark.createDataFrame([("a", "Sub", "n", "v1", None), ("b", "adds", "n", "v1", "cpp"), ("c", " ", "n", "v1", None), ("d", "x", "", "v1", None)], "query_id string, text string, namespace string, version string, language string")
    answers, audit = knowledge.query_batch(held, asked, 2)
    assert ids(audit.select("query_id", F.coalesce("error", F.lit("")).alias("error"), "documents"), "query_id", "error", "documents") == [("a", "", 1), ("b", "", 1), ("c", "EMPTY_QUERY", 0), ("d", "SCOPE_REQUIRED", 0)]
    assert ids(answers.where("rank = 1"), "query_id", "id", "route") == [("a", 2, "name"), ("b", 1, "semantic")]


YAML = "name: {0}\nnamespace: com.x.v1\nversion: v1\nchunk_id: com.x.v1.{1}\nlanguage: cpp\nkind: function\ndescription: does {0}\n"


def test_index_with_vectors(spark):
    files = spark.createDataFrame([("a.yaml", YAML.format("Add", "add")), ("b.yaml", YAML.format("Sub", "sub")), ("c.yaml", YAML.format("Sub", "sub")), ("d.yaml", "a: [")], "path string, text string")
    table = spark.createDataFrame([], "id string, namespace string, name string, description string, dense_embedding array<float>, sparse_embedding map<int,double>")
    rows, record = knowledge.build_index(files, table, F.lit(1), embed=knowledge.hash_embedding)
    row = rows.collect()
    assert [r["name"] for r in row] == ["Add"] and len(row[0]["dense_embedding"]) == 64 and row[0]["sparse_embedding"]
    assert knowledge.run_record(record, knowledge.index_errors(files)).first().asDict() == {"parsed": 3, "failed": 1, "duplicate": 2, "indexed": 1, "errors": 2, "status": "partial", "dry_run": False}
    same, dry = knowledge.build_index(files.where("path < 'b'"), table, F.lit(1), dry_run=True)
    assert same.count() == 0 and knowledge.run_record(dry, knowledge.index_errors(files.where("path < 'b'"))).first()["status"] == "dry_run"
    shown = knowledge.index_preview(files, F.lit(1))
    assert shown.where("error IS NULL AND fields LIKE '%does%'").count() >= 2 and shown.where("error IS NOT NULL").count() == 1
    assert api_documents.ready(api_documents.parse(files).where("path = 'a.yaml'")).first()["ok"]


def test_reindex_reports(spark):
    artifacts = wiki(spark, ("a", "Add", ""), ("b", "Sub", ""))
    index = spark.createDataFrame([("a", "w", "n", "v1", 1, 0.5)], "id string, wiki_id string, namespace string, version string, token_id int, weight double")
    same, problems = knowledge.reindex(artifacts, index, WHERE, dry_run=True)
    assert same.count() == 1 and ids(problems, "id", "problem") == [("b", "missing")]
    assert knowledge.reindex_report(artifacts, problems, WHERE, 1, True) == {"status": "dry_run", "discovered": 2, "indexed": 0, "batches": 0, "problems": 1, "warnings": ["DRY_RUN_NO_INDEX_WRITE"]}
    with pytest.raises(ValueError, match="twice"):
        knowledge.reindex(artifacts.union(artifacts), index, WHERE)


def test_profiles_and_embedders(spark):
    schema = knowledge.profile_schema([{"name": "id", "type": "string", "nullable": False}, {"name": "v", "type": "array<float>", "metric": "cosine", "dimension": 64}])
    profiles = knowledge.Profiles(knowledge.Profile("api", schema), knowledge.Profile("wiki", schema, top_k=5), collections={"docs": "wiki"})
    assert profiles.resolve().name == "api" and profiles.resolve(collection="docs").top_k == 5 and profiles.resolve("api").schema["v"].metadata == {"metric": "cosine", "dimension": 64}
    with pytest.raises(KeyError):
        profiles.resolve("none")
    vector = spark.createDataFrame([("a b c",), ("",)], "t string").select(profiles.resolve().embed(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in vector[0]["v"]) == pytest.approx(1, abs=1e-5) and set(vector[1]["v"]) == {0.0}
    assert knowledge.empty_reader(spark)("q", WHERE, 3).count() == 0


def test_answer_flows(spark):
    docs = spark.createDataFrame([(1, "Add adds. It is fast."), (2, "Sub subtracts.")], "id long, text string")
    questions = spark.createDataFrame([("x", "what does Add do", ["d2", "d1"]), ("y", "zzz", [])], "question_id string, question string, document_ids array<string>")
    contexts = spark.createDataFrame([], "question_id string, source string, text string, rank int")
    none = "There is no context for this question."
    assert ids(knowledge.FLOWS["direct"]()(questions, contexts), "question_id", "answer") == [("x", none), ("y", none)]
    assert ids(knowledge.FLOWS["retrieved"](docs)(questions, contexts), "question_id", "answer") == [("x", "Add adds."), ("y", none)]
    given = spark.createDataFrame([("d1", "One. Two."), ("d2", "Three")], "document_id string, content string")
    assert ids(knowledge.FLOWS["given"](given)(questions, contexts), "question_id", "answer") == [("x", "Three One."), ("y", none)]


def test_test_set_rounds(spark):
    docs = spark.createDataFrame([(f"f{i:03d}",) for i in range(300)], "filename string")
    groups = spark.createDataFrame([(g, [f"f{i:03d}" for i in range(5 * g, 5 * g + 5)]) for g in range(40)], "group_id long, files array<string>")
    used = spark.createDataFrame([("f000",)], "filename string")
    found = knowledge.test_set_rounds(docs, groups, used, 4, 9).collect()
    sizes = [sum(r["round"] == n for r in found) for n in range(4)]
    assert len(found) == 299 and max(sizes) - min(sizes) <= 1
    modes = {m: sum(r["mode"] == m for r in found) for m in ("single", "comparison", "mixed")}
    assert modes["single"] > 200 and modes["comparison"] > 5 and modes["mixed"] > 5 and all(r["selected"][0] == r["filename"] for r in found)


def test_graph_exports_by_type_and_tier(spark):
    relations = spark.createDataFrame([("a", "b", "m.b", "depends_on", "必须"), ("a", "c", "c", "references", "参见")], "source_id string, target_id string, target_name string, relation_type string, quote string")
    row = graph.export_batches(graph.build_edges(relations, "w"), 10).first()
    assert row["by_type"] == {"depends_on": 1, "references": 1} and sum(row["by_tier"].values()) == 2 and row["is_last"]
