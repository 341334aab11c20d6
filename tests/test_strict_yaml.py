import pytest
from test_sources import V1, V21

from corvia.sources import api_documents as api

CASES = {
    "v1": (V1, None), "v21": (V21, None), "latin": (None, "YAML_PARSE_ERROR"), "broken": ("a: [1", "YAML_PARSE_ERROR"), "twice": ("a: 1\nb: {c: 1, c: 2}\n", "YAML_DUPLICATE_KEY"), "two": (V1 + "---\n" + V1, "MULTI_DOCUMENT_YAML_NOT_SUPPORTED"),
    "empty": ("", "MULTI_DOCUMENT_YAML_NOT_SUPPORTED"), "list": ("- 1\n- 2\n", "YAML_ROOT_NOT_MAPPING"), "null": ("null", "YAML_ROOT_NOT_MAPPING"), "text": ("just words", "YAML_ROOT_NOT_MAPPING"), "own id": ("_id: 1\n" + V1, "SCHEMA_VALIDATION_ERROR"),
    "version": (V1.replace("'1.0'", "'9.9'"), "UNSUPPORTED_SCHEMA_VERSION"), "lacks": ("schema_version: '2.1'\nuuid: null\n", "SCHEMA_VALIDATION_ERROR"), "date": (V1.replace("{schema_version: '1.0'}", "{schema_version: '1.0', day: 2024-01-02}"), "BSON_ENCODING_ERROR"), "number": (V1 + "extra: 99999999999999999999\n", "BSON_ENCODING_ERROR"), "key": (V1 + "extra: {1: a}\n", "BSON_ENCODING_ERROR"), "long": (V1 + "# " + "x" * 4000, "FILE_TOO_LARGE"),
}


@pytest.fixture
def strict(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in CASES.items()], "path string, text string")
    return api.read_strict(files, 4000)


def test_every_code(strict):
    assert {r["path"]: r["code"] for r in strict.drop("payload").collect()} == {p: code for p, (_, code) in CASES.items()}
    assert {code for _, code in CASES.values()} | {"BSON_DOCUMENT_TOO_LARGE"} == {None, *api.READ_CODES}


def test_a_payload_that_is_too_long_to_store(spark, monkeypatch):
    monkeypatch.setattr(api, "MOST_STORED", 100)
    files = spark.createDataFrame([("a", V1)], "path string, text string")
    assert api.read_strict(files).first()["code"] == "BSON_DOCUMENT_TOO_LARGE"


def test_versions_and_values_come_from_the_variant(spark, strict):
    assert dict(strict.dtypes)["payload"] == "variant"
    held = {r["path"]: r for r in strict.select("path", "schema_version", "message", api.at("$.signature.code").alias("code"), api.at("$.documents[0].use.product_support[0].supported", "boolean").alias("flag")).collect()}
    assert held["v1"]["schema_version"] == "1.0" and held["v1"]["code"] == "int Add()" and held["v1"]["flag"] is None
    assert held["v21"]["schema_version"] == "2.1" and held["v21"]["flag"] is True and held["version"]["schema_version"] == "9.9" and held["broken"]["schema_version"] is None
    assert "root.source: missing" in held["lacks"]["message"]


def test_identities_are_those_of_the_records(spark, strict):
    """The same names as the record builder gives."""
    found = {(r["path"], r["name"], r["language"]) for r in api.identities(strict).collect()}
    good = spark.createDataFrame([("v1", V1), ("v21", V21)], "path string, text string")
    assert found == {(r["path"], r["name"], r["language"]) for r in api.parse(good).collect()}
