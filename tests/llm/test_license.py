import duckdb

from corvia.llm import license as L


def test_oracle(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    found = L.query(spark.read.parquet(path))
    key = lambda r: (r[0], str(r[1:]))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, duckdb.sql(L.oracle()).select(*found.columns).fetchall()), key=key)


def test_inheritance(spark):
    files = spark.createDataFrame([
        ("r/LICENSE", "Released under the MIT License."), ("r/a.txt", "code"), ("r/d/LICENSE", "Licensed under the Apache License, Version 2.0."), ("r/d/e/f/b.txt", "code"),
        ("r/d/e/c.txt", "Licensed under CC BY-NC 4.0.\ncode"), ("s/x.txt", "code"), ("r/d2/y.txt", "The license of this book is not told here at all, so nothing follows"), (None, None), ("r/z.txt", None), ("r/a.txt", "code"), ("top.txt", "x"), ("r/empty/LICENSE", ""),
    ], "path string, text string").selectExpr("*", "'clash' AS license", "1 AS cosine")
    rows = [(r["path"], r["license"], r["inherited_from"]) for r in L.scan(files).collect()]
    assert sorted(rows, key=str) == sorted([
        ("r/LICENSE", "MIT", None), ("r/a.txt", "MIT", "r"), ("r/a.txt", "MIT", "r"), ("r/d/LICENSE", "Apache-2.0", None), ("r/d/e/f/b.txt", "Apache-2.0", "r/d"), ("r/d/e/c.txt", "CC-BY-NC-4.0", None),
        ("s/x.txt", None, None), ("r/d2/y.txt", "MIT", "r"), (None, None, None), ("r/z.txt", "MIT", "r"), ("top.txt", None, None), ("r/empty/LICENSE", "MIT", "r"),
    ], key=str)


def test_odd_rows(odd_docs, no_docs):
    assert L.query(odd_docs).count() == odd_docs.count()
    assert L.query(no_docs).count() == 0
