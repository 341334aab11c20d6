import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "the quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing "


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns with clashing names."""
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "en", None, 3), (4, LINE * 8, "en", "a", 1), (4, LINE * 8, "en", "a", 1),
        (5, LINE * 8, "en", "b", 1), (None, LINE * 8 + "tail", None, None, None), (None, None, None, None, None), (7, "123 456 -- !!", "de", "b", 5),
        (9007199254740993, "ein kurzer deutscher text mit wenigen worten und noch etwas mehr", "de", "c", 9), (8, " ".join(f"w{i % 977}x" for i in range(120_000)), "en", "c", 7),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    clashing = ["size", "copies", "taken", "target", "source_size", "fp", "component_id", "rank", "shard", "slot", "key", "score", "lang_pred", "spans", "kept", "n_words", "distance", "piece", "start", "length", "sequence_id", "offset", "w", "n", "_key", "_salt", "_rate", "_copy", "_class", "_at", "_in", "_rank", "_text", "_hash", "_w", "_doc", "_row", "_id", "doc", "copy", "words", "a.b"]
    return docs.withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
