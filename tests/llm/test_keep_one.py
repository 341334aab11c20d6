from corvia.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_id_are_kept(spark):
    texts = ["one of a kind with quite a few words of its own", "another text that is like no other one here at all", "a third text which shares its id with the next one"]
    rows = [(None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(None, texts[0]), (3, texts[1]), (3, texts[2])], key=str)
