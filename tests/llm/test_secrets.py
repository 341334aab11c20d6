import random

import pytest

from corvia.llm import secrets as S


@pytest.fixture(scope="module")
def pair():
    return S.MarkovPair.fit(S.random_strings(), S.identifiers(["plain words make ordinary names for values, counts and other things of a program " * 20]))


@pytest.mark.parametrize(("text", "spans"), [
    ("", []),
    ("token=my-secret =abcdefghijklmnop", []),  # the short match takes the second key word with it
    ('password: "abcdefghij12"', [("assign", 0, 23)]),
    ("API_KEY='0123456789abcdef'", [("assign", 0, 25), ("hex", 9, 25)]),
    ("AKIA" + "A" * 13 + " AKIA" + "B" * 14, [("access", 18, 36)]),
    ("x" + "0" * 16 + "g" + "f" * 15, [("hex", 1, 17)]),
    ("ſecret=abcdefghijklmnop", []),  # letters match in either case among ASCII only
    ("é token=aaaaaaaaaaaa", [("assign", 2, 20)]),
])
def test_base(text, spans):
    assert S.base_spans(text) == spans


def test_models_tell_keys_from_names(pair):
    rng = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(200)]
    names = ["_".join(rng.choices(["plain", "words", "names", "value", "counts", "other"], k=5)) + "2" for _ in range(200)]
    found = lambda s: any(k == "markov" for k, _, _ in S.all_spans(f"see {s} there", pair)[1])
    assert sum(map(found, keys)) >= 195
    assert sum(map(found, names)) <= 2


def test_redacted():
    assert S.redacted("a b c d", [("hex", 2, 3), ("assign", 2, 5)]) == "a [SECRET] d" or S.redacted("a b c d", [("assign", 2, 5), ("hex", 4, 5)]) == "a [SECRET] d"
    assert S.redacted("abc", []) == "abc"


def test_odd_rows(odd_docs, no_docs, pair):
    found = S.query(odd_docs).collect()
    assert len(found) == odd_docs.count()
    assert all(r["spans"] == "" for r in found if r["doc_id"] in (1, 2, 3))
    assert S.query(no_docs).count() == 0
    cleaned = S.redact(odd_docs, pair)
    assert cleaned.columns == odd_docs.columns and cleaned.count() == odd_docs.count()


def test_redact_in_place(spark, pair):
    docs = spark.createDataFrame([(1, "key token=abcdefghijklmnop end", 3), (2, "clean text", 3), (3, None, 3)], "doc_id long, text string, n_chars long")
    assert [(r["text"], r["n_chars"]) for r in S.redact(docs, pair).orderBy("doc_id").collect()] == [("key [SECRET] end", 16), ("clean text", 10), (None, None)]
