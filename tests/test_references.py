"""Character references of pages, with and without their semicolons."""

import duckdb

from corvia.functions import pages
from corvia.plans import registry


def test_references_that_are_cut_off(spark, tmp_path):
    body = "<p>Long enough to be an article.</p></article>"
    titles = ["a &amp;&amp", "a &amp;&amp;", "b &am", "c &lt;x&gt", "&amplt; d", "e & f"]
    rows = [(i, f"http://h/{i}", f"<article><h1>{t}</h1>{body}") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = registry.QUERIES["page_articles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(registry.ORACLES["page_articles"]).fetchall())
    assert {r["title"] for r in found} == {"a &&amp", "a &&", "b &am", "c <x&gt", "&amplt; d", "e & f"}


def test_references_as_browsers_read_them():
    assert pages.parse("<article><h1>a &amp</h1><p>Long enough to be an article.</p></article>", "http://h/a", pages.Options())["title"] == "a &"
    assert pages.closed_references("&amp; &#38; &#x26; &hellip; &nothing; &amp &") == "&amp; &#38; &#x26; &hellip; &amp;nothing; &amp;amp &amp;"
