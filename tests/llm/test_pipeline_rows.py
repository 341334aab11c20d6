"""What each stage keeps of odd rows."""

from collections import Counter

import corpus_pipeline as P
from conftest import LINE
from corvia.llm import shingles

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "AKIA" + "Q" * 16


def test_rows_of_every_stage(spark, sf):
    de = "der die und das mit von nicht ist ein haus am see und viele leute gehen dort hin weil es so schön ist "
    rows = [(i, f"{LINE} {LINE} number{i} of these", "en", "a", 0) for i in range(40)] + [(100 + i, f"{de} {de} nummer{i} hier", "de", "b", 0) for i in range(40)]
    odd = [
        (None, f"some words without an id that are like no other here {LINE}", "en", "a", 0), (None, f"some words without an id that are like no other here {LINE}", "en", "a", 0), (None, None, None, None, None), (500, "", "en", "a", 0), (501, "123 -- 456", "en", "a", 0),
        (502, f"the key is {KEY} as it seems and this text is of a kind of its own with words", "en", None, 0), (503, "a text that shares its id with another one here", "en", "a", 0), (503, "another text with the same id but with other words of its own in it", "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long")
    at, tables = docs, {}
    for name, stage in P.STAGES:
        found = stage(spark, at, sf)
        at = spark.createDataFrame(found.collect(), found.schema)
        tables[name] = at.collect()
    assert all(tuple(spark.createDataFrame(tables[n]).columns) == COLUMNS for n, _ in P.STAGES[:-1])
    known = tables["language_id"]
    assert len(known) == 80 + 2 + 3 and not {500, 501} & {r["doc_id"] for r in known} and all(r["text"] for r in known)
    classes = {}
    for r in shingles.near_duplicates(docs.where("text IS NOT NULL").join(spark.createDataFrame([(r["text"],) for r in known], "text string").distinct(), "text").selectExpr("xxhash64(text) AS doc_id", "text")).collect():
        classes.setdefault(r["component_id"], set()).add(r["doc_id"])
    kept = tables["near_dedup"]
    assert len(kept) == len(classes) and sum(r["doc_id"] is None for r in kept) == 1 and sum(r["doc_id"] == 503 for r in kept) == 2
    safe = tables["secret_scan"]
    assert len(safe) == len(kept) and not any(KEY in r["text"] for r in safe) and any("[SECRET]" in r["text"] for r in safe)
    mixed = Counter(r["text"] for r in tables["mix_sources"])
    assert set(mixed) <= {r["text"] for r in safe} and max(mixed.values()) <= 2
    pieces = tables["pack"]
    assert sum(r["piece"] == 0 for r in pieces) == sum(mixed.values()) and sum(r["doc_id"] is None for r in pieces) <= 2
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
