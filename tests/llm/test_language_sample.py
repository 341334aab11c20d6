import time

from corvia.llm import language as L

EN, DE, FR = "the and of this that with from into over", "der die und das mit von nicht ist ein", "le la les des une pour dans avec est"


def predicted(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return {r["doc_id"]: r["lang_pred"] for r in L.query(docs).collect()}


def test_a_language_of_copies_is_learned(spark):
    for k in range(3):
        rows = [(i, f"{FR} {k}", "fr") for i in range(600)] + [(1000 + i, f"{EN} number {i}", "en") for i in range(200)] + [(2000 + i, f"{DE} nummer {i}", "de") for i in range(200)]
        found = predicted(spark, rows)
        assert all(found[i] == lang for i, _, lang in rows)


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(i, f"{FR} " * 400 + f"n{i}", "fr") for i in range(30)] + [(100 + i, f"{EN} " * 3 + f"n{i}", "en") for i in range(30)]
    assert min(len(t) for _, t, lang in rows if lang == "fr") > L.SAMPLE_CHARS
    found = predicted(spark, rows)
    assert all(found[i] == lang for i, _, lang in rows)


def test_more_languages_than_a_hundred(spark):
    rows = [(i * 1000 + j, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{x}{y}" for x in "aeiou" for y in "xyz"), f"l{i:03d}") for i in range(130) for j in range(6)]
    found = predicted(spark, rows)
    assert sum(found[i] == lang for i, _, lang in rows) > 0.95 * len(rows)


def test_words_of_any_length(monkeypatch):
    words = [b"x" * n for n in (1, 30, 70, 500)]
    want = {i: sorted(f[f >= 0].tolist()) for i, f in ((int(i), f) for at, fs in L.word_features(words) for i, f in zip(at, fs, strict=True))}
    monkeypatch.setattr(L, "CELLS", 256)  # words of over 64 bytes in pieces
    pieces = {}
    for at, fs in L.word_features(words):
        for i, f in zip(at, fs, strict=True):
            pieces.setdefault(int(i), []).extend(f[f >= 0].tolist())
    for i in range(4):
        grams = lambda xs: sorted(x for x in xs if x < L.BUCKETS)
        assert grams(pieces[i]) == grams(want[i]) and len(pieces[i]) == len(want[i])
    monkeypatch.undo()
    crf = L.Crf(["de", "en"]).fit(L.chains_of([(f"{DE} " * 20, 0), (f"{EN} " * 20, 1)] * 4), epochs=4, batch=16)
    began = time.perf_counter()
    (lang, _), = crf.predict([f"{EN} " + "q" * 30_000_000 + f" {EN}"])
    assert lang == "en" and time.perf_counter() - began < 60
