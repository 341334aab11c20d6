import os

import pytest
from pyspark.sql import functions as F

from corvia.sources.document_trees import SPLIT, TreeReader, register


def read(spark, root, **options):
    return spark.read.format("documents").options(path=str(root), **options).load()


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


@pytest.fixture(autouse=True)
def known(spark):
    register(spark)


def test_a_tree_of_many_files(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.lit("d"), F.col("id") % 50, F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), F.repeat(F.lit("é "), (F.col("id") % 90).cast("int")).alias("text"))
    rows.repartition(4).write.format("documents").option("path", str(tmp_path)).mode("append").save()
    assert len(listed(tmp_path)) == 10_000
    found = read(spark, tmp_path, splitBytes=64 << 20)
    assert found.rdd.getNumPartitions() == 10  # 10,000 openings and under 1 MB in splits of 64 MiB
    back = found.select("path", "text", "length").join(rows.withColumnRenamed("text", "want"), "path")
    assert back.count() == 10_000 and back.where("text <> want OR length <> octet_length(want)").count() == 0
    some = read(spark, tmp_path).where("length > 200 AND path LIKE 'd7/%'")
    assert some.count() == rows.where("octet_length(text) > 200 AND path LIKE 'd7/%'").count() > 0


def test_conditions_reach_the_list_of_files(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, StringStartsWith

    for name, text in (("a/x.md", "1"), ("a/y.md", "22"), ("b/z.md", "333"), ("b/no.bin", "4"), ("a/.hidden.md", "5"), ("_writing/k.md", "6")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    reader = TreeReader({"path": str(tmp_path)})
    assert [f[0] for f in reader.partitions()[0].files] == ["a/x.md", "a/y.md", "b/z.md"]
    left = list(reader.pushFilters([StringStartsWith(("path",), "a/"), GreaterThan(("length",), 1), IsNotNull(("path",)), EqualTo(("text",), "22")]))
    assert len(left) == 2 and [f[0] for f in reader.partitions()[0].files] == ["a/y.md"]
    small = TreeReader({"path": str(tmp_path), "maxbytes": "2", "splitbytes": "1"})
    assert [[f[0] for f in s.files] for s in small.partitions()] == [["a/x.md"], ["a/y.md"]] and SPLIT > 1


def test_files_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"\xff\xfe")
    (tmp_path / "b.md").write_text("")
    assert {r["path"]: r["text"] for r in read(spark, tmp_path).collect()} == {"a.md": None, "b.md": ""}
    assert read(spark, tmp_path, extensions=".none").count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    rows = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../out.md")).otherwise(F.concat(F.col("id"), F.lit(".md"))).alias("path"), F.lit("t").alias("text")).repartition(4)
    with pytest.raises(Exception, match="unsafe path"):
        rows.write.format("documents").option("path", str(tmp_path)).mode("append").save()
    assert listed(tmp_path) == []
    twice = spark.createDataFrame([("a.md", "1"), ("a.md", "2")], "path string, text string")
    with pytest.raises(Exception, match="twice"):
        twice.write.format("documents").option("path", str(tmp_path)).mode("append").save()
    assert listed(tmp_path) == []


def test_append_and_overwrite(spark, tmp_path):
    def put(mode, **texts):
        spark.createDataFrame([(f"{k}.md", t) for k, t in texts.items()], "path string, text string").write.format("documents").option("path", str(tmp_path)).mode(mode).save()

    put("append", a="1", b="1")
    put("append", b="2", c="2")
    assert {r["path"]: r["text"] for r in read(spark, tmp_path).collect()} == {"a.md": "1", "b.md": "2", "c.md": "2"}
    put("overwrite", d="3")
    assert listed(tmp_path) == ["d.md"]


def test_what_the_driver_is_sent_does_not_grow_with_the_files(tmp_path):
    import pickle

    from corvia.sources.document_trees import TreeWriter

    writer = TreeWriter({"path": str(tmp_path)}, False)
    few, many = (writer.write(iter([{"path": f"{n}/é {i}\n.md", "text": "t"} for i in range(n)])) for n in (2, 500))
    assert len(pickle.dumps(many)) == len(pickle.dumps(few))
    writer.commit([few, None, many])
    assert len(listed(tmp_path)) == 502 and "2/é 1\n.md" in listed(tmp_path)
