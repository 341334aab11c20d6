import json

import pytest
from pyspark.sql import functions as F

from corvia.operators.state import NotFound
from corvia.plans import knowledge
from corvia.schemas import API_DOCUMENT, T
from corvia.sources import api_documents as api
from corvia.sources import connectors, files
from corvia.streaming import hits

V1 = "chunk_id: com.x.v1.add\nnamespace: com.x.v1\nname: Add(int a)\nlanguage: python\ncategory: op\ntitle: Add\nlayman_explanation: adds\nraw: {schema_version: '1.0'}\nbody_md: ''\nkind: function\nversion: v1\nsignature: {code: int Add()}\n"
V21 = """schema_version: '2.1'
uuid: null
source: {source_path: null, source_url: 'https://h/a', content_hash: 'sha256:1', source_markdown: '', preprocess_markdown: '', resources: []}
documents:
- name: Sub-It
  namespace: com.x
  version: v2
  language: cpp
  use:
    summary: {value: subtracts, is_ai: false}
    category: {value: function, is_ai: true}
    description: {value: takes away, is_ai: false}
    product_support: [{product: A1, supported: true, is_ai: false}, {product: B2, supported: false, is_ai: false}]
    prerequisites: []
    function_details: {input_parameters: [{name: a, type: int, description: 'x|y', is_ai: false}], output_parameters: [], signature: {value: int Sub(), is_ai: false}}
    data_structure: {fields: []}
    examples: [{value: 'Sub()', is_ai: false}, {value: ' ', is_ai: false}]
"""


@pytest.fixture
def folder(tmp_path):
    for name, text in {"a/Sub/one.yaml": V1, "a/sub/two.yml": V21, "a/Sub/dup.yaml": "a: 1\na: 2\n", "a/Sub/copy.yaml": V1, "a/other/three.yaml": V1, "m/x.md": "# X\ntext", "m/dist/y.md": "junk", "m/empty.md": "", "m/z.markdown": "zz"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_yaml(spark, folder):
    found = api.parse(files.yaml_files(spark, str(folder / "a")))
    rows = found.collect()
    assert len(rows) == 4 and [r["error"] is None for r in rows].count(False) == 1
    by = {r["name"]: r for r in rows if r["error"] is None}
    assert by["Add(int a)"]["id"] == "com.x.v1.add" and by["Add(int a)"]["signature"] == "int Add()"
    assert by["Sub-It"]["id"] == "com.x.v2.Sub-It" and by["Sub-It"]["source"] == "https://h/a" and "x\\|y" in by["Sub-It"]["parameters_md"] and by["Sub-It"]["examples"] == ["Sub()"] and by["Sub-It"]["version_support"] == ["A1"]
    assert [r["id"] for r in api.unique(found.where("error is null")).collect()] == ["com.x.v2.Sub-It"]
    issues = {r["path"].rsplit("/", 1)[-1]: r["issues"] for r in api.validate(files.yaml_files(spark, str(folder / "a"))).collect()}
    assert issues["one.yaml"] == [] and issues["two.yml"] == [] and issues["dup.yaml"] == ["NOT_YAML"]
    ready = {r["name"]: r["ok"] for r in api.ready(found.where("error is null")).collect()}
    assert ready == {"Add(int a)": True, "Sub-It": False}


@pytest.mark.parametrize(("change", "issue"), [
    (lambda d: d.pop("uuid"), "root.uuid: missing"), (lambda d: d.update(extra=1), "root.extra: unexpected"), (lambda d: d["source"].update(source_path="x"), "root.source: one of source_path and source_url"),
    (lambda d: d["source"].update(content_hash="md5:1"), "root.source.content_hash: no sha256"), (lambda d: d["documents"][0]["use"]["category"].update(value="other"), "root.documents[0].use.category: other"),
    (lambda d: d["documents"][0]["use"]["description"].update(value="x" * 301), "root.documents[0].use.description: too long"), (lambda d: d["documents"][0]["use"].update(summary="plain"), "root.documents[0].use.summary: no value with is_ai"),
    (lambda d: d["source"]["resources"].extend([{"resource_id": "r", "kind": "link", "raw": {"resolved_uri": "u", "anchor_text": {"value": "a", "is_ai": False}, "title": {"value": None, "is_ai": False}, "criticality": "huge"}}]), "root.source.resources[0].raw.criticality: huge"),
    (lambda d: d.update(documents=[]), "root.documents: empty"), (lambda d: d.update(schema_version="3"), "unknown schema version 3"),
])
def test_nested_schema(change, issue):
    package = api.load_unique(V21)[0]
    assert api.issues_of(package) == []
    change(package)
    assert api.issues_of(package) == [issue]


def test_build_index(spark, folder):
    columns = [f.name for f in API_DOCUMENT if f.name not in ("dense_embedding", "sparse_embedding")]
    table = spark.createDataFrame([], T.StructType([API_DOCUMENT[c] for c in columns]))
    built, record = knowledge.build_index(files.yaml_files(spark, str(folder / "a")), table, F.lit(7).cast("long"))
    row = built.first()
    assert built.columns == columns and row["id"] == "com.x.v2.Sub-It" and row["deprecated"] is False and row["ingested_at"] == 7
    assert record.first().asDict() == {"parsed": 3, "failed": 1, "indexed": 1, "duplicate": 2, "dry_run": False}


def test_markdown_and_manifest(spark, folder):
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in files.markdown_files(spark, str(folder / "m")).collect()) == ["x.md", "z.markdown"]
    (folder / "list.txt").write_text("a.md\n\n# note\nb.txt\na.md\nc.markdown\n")
    good, bad = files.manifest(spark, str(folder / "list.txt"))
    assert [r["path"] for r in good.collect()] == ["a.md", "c.markdown"] and [(r["line"], r["path"]) for r in bad.collect()] == [(4, "b.txt")]
    docs = spark.createDataFrame([("a", "text"), ("b", " ")], "document_id string, content string")
    found, problems = files.retrieve(docs, spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), ("../x", 4), ("c", 5)], "document_id string, ord int"))
    assert [(r["document_id"], r["ord"]) for r in found.collect()] == [("a", 1)]
    assert sorted((r[0], r[1]) for r in problems.collect()) == [("../x", "unsafe"), ("b", "empty"), ("c", "missing")]


def test_json_lines(spark, folder):
    (folder / "ok.jsonl").write_text(json.dumps({"a": 1}) + "\n")
    (folder / "bad.jsonl").write_text('{"a": 1}\n[1]\nno\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert files.json_lines(spark, str(folder / "ok.jsonl"), schema).collect()[0]["a"] == 1
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        files.json_lines(spark, str(folder / "bad.jsonl"), schema).collect()
    assert sorted(r["value"] for r in files.bad_json_lines(spark, str(folder / "bad.jsonl")).collect()) == ["[1]", "no"]


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(NotFound):
        files.open_table(spark, path)
    old = T.StructType([T.StructField("id", T.StringType())])
    assert files.open_or_create(spark, path, old).count() == 0
    files.append(spark.createDataFrame([("a",)], old), path)
    wider = T.StructType([*old.fields, T.StructField("n", T.LongType())])
    assert files.open_table(spark, path, wider).collect() == [("a", 0)]
    scoped = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, scope string")
    files.write_snapshot(scoped, str(tmp_path / "s"), ["scope"])
    files.write_snapshot(scoped.where("scope = 'x'").withColumn("id", F.lit("new")), str(tmp_path / "s"), ["scope"])
    assert sorted((r["id"], r["scope"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [("b", "y"), ("new", "x")]


def test_connectors(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    assert connectors.load(spark, "folder", path=str(tmp_path)).first()["html"] == "<p>x</p>"
    with pytest.raises(KeyError):
        connectors.load(spark, "web")


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b"), ("", "x"), (None, "y"), ("d", "a")], "collection string, api_id string")
    events.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        hits.start_counter(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    counts = hits.counted(spark.read.parquet(str(tmp_path / "out")))
    assert [(r["api_id"], r["hits"], r["x"]) for r in hits.top_hits(counts, "c").orderBy("x").collect()] == [("a", 2, 0), ("b", 1, 1)]
    assert [r[0] for r in hits.collections(counts).collect()] == ["c", "d"]
    assert hits.top_hits(counts, "c", 0).count() == 0


def test_document_stream(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "h1", "f", 1), ("d1", "h2", "f", 2), ("d2", "h", "f", 1)], "document_id string, content_hash string, fingerprint string, updated_at int")
    docs.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("d2", "h", "f", 0)], docs.schema).write.parquet(str(tmp_path / "state0"))
    written = []
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    hits.start_document_updates(stream, lambda s: s.read.parquet(str(tmp_path / "state0")), lambda df, n: written.append(sorted(map(tuple, df.collect()))), str(tmp_path / "check")).awaitTermination()
    assert written == [[("d1", "h2", "f", 2), ("d2", "h", "f", 0)]]
