import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvia.llm import middle as M


def brute(doc_id, text):
    """Form, output, n and lengths by slices of characters."""
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= 90:
        return "plain", text, n, None, None
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")) + (n, lo, hi - lo)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expect(rows):
    found = []
    for doc_id, text in rows:
        form, output, n, a, b = brute(doc_id, text)
        found.append((doc_id, n, form, a, b, digest(output), digest(text or "")))
    return sorted(found, key=repr)


def test_query_on_odd_rows(odd_docs, no_docs):
    got = [tuple(r) for r in M.query(odd_docs).collect()]
    assert sorted(got, key=repr) == expect([(d["doc_id"], d["text"]) for d in odd_docs.collect()])
    assert M.query(no_docs).count() == 0


def test_texts_of_all_widths(spark, monkeypatch):
    rng = random.Random(5)
    pool = [*"ab <S>P/M\n", "é", "ß", "漢", "🙂", "́", "<", "<S", "<P>", "\0"]
    rows = [(i, "".join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in M.query(df).collect()), key=repr)
    assert got == expect(rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_stretches_of_a_batch():
    import pyarrow as pa

    texts = pa.array(["ab", "", "x" * 50, "é" * 3, "漢" * 9, ""])
    assert [list(x) for x in (M.slices(texts, 8),)][0] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 6)] or [b for _, b in M.slices(texts, 8)][-1] == 6
    hashes = pa.array([hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)])
    whole = M._cut(texts, hashes, 100, 20, M.MARKS).to_pylist()
    parts = [r for a, b in M.slices(texts, 8) for r in M._cut(texts[a:b], hashes[a:b], 100, 20, M.MARKS).to_pylist()]
    assert whole == parts


def test_runs_find_every_character():
    import numpy as np

    texts = ["aéé漢🙂🙂b", "", "éa", "漢漢漢"]
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])
    runs = M.Runs(np.frombuffer(b"".join(raw), np.uint8), starts)
    for i, t in enumerate(texts):
        for k in range(len(t) + 1):
            assert runs.byte_of(runs.first_units[i : i + 1] + k)[0] - starts[i] == len(t[:k].encode())


@pytest.mark.parametrize("raw", [b"\x80\x80ab", b"a\xff\xfe\x80", b"\xc3"])
def test_bytes_that_are_no_text(spark, raw):
    df = spark.createDataFrame([(1, bytearray(raw))], "doc_id long, raw binary").select("doc_id", F.expr("cast(raw as string)").alias("text"))
    made = df.select("text", M.transform(F.col("text"), M.id_hash(F.col("doc_id")), cut=100).alias("m")).select("text", "m.*", M.restore(F.col("m.output"), F.col("m.form")).alias("back"))
    assert made.where("cast(back as binary) = cast(text as binary)").count() == 1


def test_marks_that_would_not_be_found_again():
    M.check_marks(("<|pre|>", "<|suf|>", "<|mid|>"))
    for bad in (("<P>", "<P>", "<M>"), ("aa", "<S>", "<M>"), ("<P>", "x<", "<M>"), ("<a", "<ab", "<c"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            M.check_marks(bad)


def test_own_marks_and_shares(spark):
    df = spark.createDataFrame([(i, f"text {i} of some words") for i in range(200)], "doc_id long, text string")
    made = df.select("text", M.transform(F.col("text"), M.id_hash(F.col("doc_id"), 7), 50, 50, ("[1", "[2", "[3")).alias("m"))
    counts = {r["form"]: r["count"] for r in made.groupBy("m.form").count().collect()}
    assert 60 < counts["plain"] < 140 and counts["psm"] > 20 and counts["spm"] > 20
    back = made.select("text", M.restore(F.col("m.output"), F.col("m.form"), ("[1", "[2", "[3")).alias("back"))
    assert back.where("text <> back").count() == 0
