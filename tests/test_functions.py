import pytest
from pyspark.sql import functions as F

from corvia.functions import markdown as md
from corvia.functions import scoring
from corvia.functions import text as t


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long' if isinstance(v, int) else 'double'}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(column).first()[0]


@pytest.mark.parametrize(("text", "tokens"), [("", []), (None, []), ("Add add_2 ADD", ["add", "add_2", "add"]), ("数据", [" 数", "数据", "据 "]), ("mm数据x", ["mm", " 数", "数据", "据 ", "x"])])
def test_tokens(spark, text, tokens):
    assert one(spark, t.tokens(F.col("s")), s=text) == tokens


def test_token_id(spark):
    import hashlib

    assert one(spark, t.token_id(F.col("s")), s="data") == int(hashlib.md5(b"data").hexdigest()[:6], 16)


@pytest.mark.parametrize(("api_id", "name"), [("com.x.op.910beta3.printf", "printf"), ("Lib::printf", "printf"), ("chunk_10023", "chunk"), ("Lib::Copy_v2", "Copy_v2"), ("plain", "plain"), ("1.0.2", "1.0.2"), ("", ""), (None, ""), ("a:b:v1", "b")])
def test_display_api_name(spark, api_id, name):
    assert one(spark, t.display_api_name(F.col("s")), s=api_id) == name


@pytest.mark.parametrize(("text", "limit", "want"), [("  short ", 10, "short"), ("abcdefghij klm", 13, "abcdefghij..."), (None, 5, ""), ("abcdefg", 6, "abc...")])
def test_trim_to(spark, text, limit, want):
    assert one(spark, t.trim_to(F.col("s"), limit), s=text) == want


def test_urls(spark):
    assert one(spark, t.canonical_uri(F.col("s")), s="HTTPS://Host.COM/A/b?x=1#y") == "https://host.com/A/b"
    assert one(spark, t.canonical_uri_requoted(F.col("s")), s="HTTPS://Host.COM/a%20b/%C3%A9?x") == "https://host.com/a%20b/%C3%A9"
    assert one(spark, t.document_id_of(F.col("s"), ["/doc/", "/doc/v1/"]), s="https://h/doc/v1/api/add.html") == "api::add"
    ok = t.allowed_uri(F.col("s"), ["h"], ["/doc/"], r"\.html$")
    assert [one(spark, ok, s=u) for u in ("https://H/doc/a.html", "ftp://h/doc/a.html", "https://g/doc/a.html", "https://h/x/a.html", "https://h/doc/a.txt", None)] == [True, False, False, False, False, False]


def test_paths_and_names(spark):
    assert [one(spark, t.safe_relative_path(F.col("s")), s=p) for p in ("a/b", "/a", "a/../b", "", "C:\\x", None)] == [True, False, False, False, False, False]
    assert [one(spark, t.collection_name_ok(F.col("s")), s=p) for p in ("docs_1", "1docs", "system.x", "A")] == [True, False, False, False]
    assert one(spark, t.safe_path_component(F.col("s")), s=' a/b:c? . ') == "a_b_c_"
    assert one(spark, t.hierarchy_key(F.col("s")), s="Straße (A_b)-c") == "strasseabc"
    assert one(spark, t.normalize_markdown(F.col("s")), s="a  \r\n\n\n\n\nb") == "a\n\n\nb\n"
    assert one(spark, t.same_content(F.col("a"), F.col("b")), a="# some visible text of a page", b="nav\nsome **visible** text of a [page](x)") is True
    assert one(spark, t.parse_hit_key("hit", F.col("s")), s="hit:docs:a:b").asDict() == {"collection": "docs", "api_id": "a:b"}
    assert one(spark, t.parse_hit_key("hit", F.col("s")), s="other:x:y") is None
    assert one(spark, t.duration(F.col("n")), n=245_000) == "4 m 05 s"


def test_edge_scores(spark):
    parts = scoring.breakdown(F.lit("depends_on"), F.lit("a::b"), F.lit(False), F.lit("必须"), F.lit(1))
    assert one(spark, scoring.score(parts)) == pytest.approx(0.35 * 0.9 + 0.25 + 0.1 + 0.15 + 0.02)
    assert [one(spark, scoring.tier(F.lit(x))) for x in (0.8, 0.5, 0.2, 0.19)] == ["strong", "moderate", "weak", "negligible"]
    assert one(spark, scoring.inverse(F.lit("superseded_by"))) == "supersedes" and one(spark, scoring.inverse(F.lit("sibling"))) == "sibling"
    assert [one(spark, scoring.evidence(F.lit(x))) for x in ("", "参见此处", "text", "需要")] == [0.1, 0.7, 0.5, 1.0]


PAGE = "# Add\n#### Function Prototype\n```cpp\nint Add(int a,\n        int b);\n```\n#### Example\n```python\nAdd(1, 2)\n```\n| a | b |\n| --- | --- |\n| 1 | x\\|y |\n\n![pic](p.png) and `![no](n.png)` ![broken(\n[doc](d.md)\n"


def test_markdown(spark):
    assert one(spark, md.minimal_unit(F.lit("add"), F.col("s"))["reason"], s=PAGE) == "api sections"
    assert one(spark, md.minimal_unit(F.lit("README"), F.col("s"))["included"], s=PAGE) is False
    assert one(spark, md.minimal_unit(F.lit("x"), F.col("s"))["reason"], s="# 概述\ntext") == "title"
    assert one(spark, md.minimal_unit(F.lit("x"), F.col("s"))["reason"], s="本章节列出接口") == "listing"
    assert [(r[1], r[2], r[5]) for r in md.resources_of(PAGE)] == [("image", "p.png", 15), ("link", "d.md", 16)]
    assert md.unparsed_images(PAGE) == [(15,)]
    assert [(b[0], b[1]) for b in md.blocks_of(PAGE)] == [("code", "Function Prototype"), ("code", "Example"), ("table", "Example")]
    assert md.signatures_of(PAGE, "Add") == ["int Add(int a, int b)"]
    assert one(spark, md.table_cells(F.col("s")), s="| 1 | x\\|y |") == ["1", "x|y"]
    assert one(spark, md.unfenced(F.col("s")), s="<think>no</think>x\n```yaml\na: 1\n```") == "a: 1"
    assert "![" not in md.preprocess(PAGE).split("```")[-1].replace("`![no](n.png)`", "").replace("![broken(", "")
    assert [(r["title"], r["body"]) for r in one(spark, md.sections(F.col("s")), s="# A\nx\n# B\ny")] == [("A", "x"), ("B", "y")]
    accepted = md.accepted_value(F.lit("Adds  two"), F.lit("it adds two numbers"), 50)
    assert one(spark, accepted).asDict() == {"value": "Adds  two", "is_ai": False}


def test_pages(spark):
    frame = spark.createDataFrame([(1, "<title>T</title><nav>menu</nav><h1>Head</h1><p>Some text of a page.</p><a href='/x'>more</a>"), (2, None), (3, "<p>x")], "page_id long, html string")
    found = {r["page_id"]: r for r in md.pages(frame, ["page_id"]).collect()}
    assert (found[1]["title"], found[1]["links"], found[1]["ok"]) == ("Head", ["/x"], True)
    assert "menu" not in found[1]["markdown"] and not found[2]["ok"] and not found[3]["ok"]
