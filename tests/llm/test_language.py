import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvia.llm import language as L


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(2, 5, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
    lengths = np.array([5, 3])
    p, pairs = L.forward_backward(scores, lengths, moves)
    want_pairs = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        total, marginal, joint = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[c, t, x] for t, x in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, x in enumerate(path):
                marginal[t, x] += w
            for a, b in itertools.pairwise(path):
                joint[a, b] += w
        assert p[c, :n] == pytest.approx(marginal / total, abs=1e-5)
        want_pairs += joint / total
    assert pairs == pytest.approx(want_pairs, abs=1e-4)


def test_features_of_long_and_odd_words():
    words = [b"", b"a", "é".encode(), b"x" * 17, b"y" * 33, b"z" * 500]
    seen = {int(i): f for at, fs in L.word_features(words) for i, f in zip(at, fs, strict=True)}
    assert sorted(seen) == list(range(6))
    assert (seen[5] >= 0).sum() == 3 * 502 - 3 + 1  # all grams of the edged word, and the word


@pytest.fixture(scope="module")
def crf():
    en, de = "the and of this that with from into over", "der die und das mit von nicht ist ein"
    return L.Crf(["de", "en"]).fit(L.chains_of([(f"{de} " * 20, 0), (f"{en} " * 20, 1)] * 4), epochs=4, batch=16)


def test_switch_within_a_text(crf):
    words = L.tokens("the and of this that der die und das mit")
    assert crf.label([words])[0].argmax(axis=1).tolist() == [1] * 5 + [0] * 5


def test_predict_odd_texts(crf):
    found = crf.predict([None, "", "123 --", "the and", "the " * 300_000, "der die"])
    assert [x for x, _ in found] == ["und", "und", "und", "en", "en", "de"]
    assert all(0 <= s <= 1 for _, s in found)
    assert L.Crf([]).predict(["text", None]) == [("und", 0.0)] * 2


def test_batches_do_not_matter(crf, monkeypatch):
    texts = ["the and of " * 100, "der die und " * 90, "of der", "12"] * 3
    want = crf.predict(texts)
    monkeypatch.setattr(L, "BATCH_WORDS", 256)
    assert [x for x, _ in crf.predict(texts)] == [x for x, _ in want]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.97


def test_odd_rows(odd_docs, no_docs):
    rows = L.query(odd_docs).collect()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert len(rows) == odd_docs.count() and by[1]["lang_pred"] == by[7]["lang_pred"] == "und"
    assert 9007199254740993 in by
    assert L.query(no_docs).count() == 0
    assert L.keep_identified(odd_docs).columns == odd_docs.columns
    assert L.keep_identified(no_docs).count() == 0
