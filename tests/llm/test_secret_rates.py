"""Both rates of the models on labelled runs that they weren't fitted on."""

import importlib
import random
import string

import pytest

from corvia.llm import secrets as S

#: Libraries whose names stand for code that the models haven't seen.
UNSEEN = ["pyspark.sql", "pyspark.sql.functions", "pyspark.ml.feature", "pyspark.ml.classification", "pyarrow", "pyarrow.compute", "numpy", "pandas", "py4j.java_gateway", "hypothesis.strategies"]
GERMAN_FRENCH = "Versicherungsnehmer Geschwindigkeitsbegrenzung Donaudampfschifffahrt Verantwortlichkeit kryptografischeSchluessel Zusammenfassung Wiederherstellung anticonstitutionnellement developpement gouvernementales responsabilisation internationalisation malheureusement".split()
CODE = "HttpServletRequestWrapper MAX_BUFFER_SIZE_BYTES_2 PyObject_GenericGetAttr AbstractSingletonProxyFactoryBean usr/local/lib/python3/dist-packages com/google/common/collect/ImmutableList x86_64-linux-gnu-gcc-12 2024-11-28T06-33-45Z node_modules/lodash/package spark-sql-kafka-0-10_2-13 getElementsByClassName".split()
ALPHABETS = {
    "hex": string.digits + "abcdef", "base32": string.ascii_uppercase + "234567", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_",
    "lower": string.ascii_lowercase + string.digits, "letters": string.ascii_letters,
}


@pytest.fixture(scope="module")
def pair(spark, sf):
    return S.train(spark.read.parquet(f"{sf}/documents.parquet"))


def unseen():
    names = set()
    for module in UNSEEN:
        for name, value in vars(importlib.import_module(module)).items():
            names |= {name, *(dir(value) if isinstance(value, type) else ())}
    known = set(S.library_names())
    names = sorted({n.strip("_") for n in names if n.isascii() and len(n.strip("_")) > 2} - known)
    return names, S.joined_names(random.Random(99), names, 20_000)


def test_ordinary_runs(pair):
    names, joined = unseen()
    runs = [n for n in {*names, *joined, *GERMAN_FRENCH, *CODE} if len(n) >= S.MIN_RUN]
    wrong = [r for r in runs if S.is_random(r, pair)]
    assert len(runs) > 10_000 and len(wrong) * 1000 < len(runs), wrong
    assert not [r for r in (*GERMAN_FRENCH, *CODE) if S.is_random(r, pair)]


#: Shares that are found by length; strings of letters alone are nearest to names.
SHARES = {12: (0.9, 0.75), 16: (0.97, 0.93), 20: (0.99, 0.97), 32: (0.998, 0.99)}


@pytest.mark.parametrize(("kind", "n", "least"), [(k, n, both[k == "letters"]) for k in ALPHABETS for n, both in SHARES.items()])
def test_keys(pair, kind, n, least):
    rng = random.Random(f"{kind}{n}")
    assert sum(S.is_random("".join(rng.choices(ALPHABETS[kind], k=n)), pair) for _ in range(1000)) >= least * 1000


def test_digits_are_numbers(pair):
    rng = random.Random(1)
    assert not any(S.is_random("".join(rng.choices(string.digits, k=n)), pair) for n in (12, 16, 24, 40) for _ in range(100))


def test_documents_without_secrets_are_left_alone(spark, sf, pair):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = S.scan(docs, pair).agg({"n_markov": "sum", "n_assign": "sum"}).first()
    assert found["sum(n_markov)"] == 0
