from collections import Counter

import corpus_pipeline as P
from corvia.llm import language, packing, secrets, simhash


def test_stages_against_the_operators(spark, sf):
    docs, tables = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        found = stage(spark, docs, sf)
        docs = spark.createDataFrame(found.collect(), found.schema)
        tables.append((name, docs))
    at = dict(tables)
    start = spark.read.parquet(f"{sf}/documents.parquet")
    assert all(at[n].columns == start.columns for n, _ in P.STAGES[:-1])
    crf = language.train(start.where(~language.held_out(start["doc_id"])))
    want = {r["doc_id"] for r in start.collect() if crf.predict([r["text"]])[0][1] >= 0.5}
    assert {r["doc_id"] for r in at["language_id"].collect()} == want
    classes = {}
    for r in simhash.near_duplicates(at["language_id"]).collect():
        classes.setdefault(r["component_id"], set()).add(r["doc_id"])
    assert {r["doc_id"] for r in at["near_dedup"].collect()} == {min(c) for c in classes.values()}
    pair = secrets.train(at["near_dedup"])
    assert {r["doc_id"]: r["text"] for r in at["secret_scan"].collect()} == {r["doc_id"]: secrets.redacted(r["text"], secrets.all_spans(r["text"], pair)[1]) for r in at["near_dedup"].collect()}
    mixed = Counter(r["doc_id"] for r in at["mix_sources"].collect())
    assert max(mixed.values()) <= 2 and set(mixed) <= {r["doc_id"] for r in at["secret_scan"].collect()}
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert abs(words(at["mix_sources"]) / words(at["secret_scan"]) - 1.5) < 0.05
    encoder = packing.WordEncoder(packing.tokenizer_file())
    tokens = sum(len(encoder.encode_long(r["text"])) + 1 for r in at["mix_sources"].collect())
    assert sum(r["length"] for r in at["pack"].collect()) == tokens


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "score"), no_docs):
        at = docs
        for _, stage in P.STAGES:
            at = stage(spark, at, sf)
        assert at.count() >= 0


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
