import json

import pytest
from pyspark.sql import functions as F

from corvia import schemas
from corvia.plans import knowledge


def document(name, n="1"):
    return f"name: {name}\nnamespace: lib.v1\nchunk_id: lib.v1.{name}\ntitle: {name}\nversion: v1\ndescription: what {name} does {n}\n"


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_a_run_writes_its_record_and_errors(spark, tmp_path):
    table = spark.createDataFrame([], schemas.API_DOCUMENT)
    some = files(spark, ("a.yaml", document("a")), ("b.yaml", document("b")), ("c.yaml", "a: [1"), ("d.yaml", document("d")), ("e.yaml", document("d", "2")))
    built, record = knowledge.ingest(some, table, F.lit(1).cast("long"), str(tmp_path), "r1", embed=knowledge.hash_embedding)
    again, plain = knowledge.build_index(some, table, F.lit(1).cast("long"))
    want = plain.first().asDict()
    assert {k: record[k] for k in want} == want and record["parsed"] == 4 == want["indexed"] + want["duplicate"]
    assert built.count() == again.count() == want["indexed"]
    on_disk = json.loads((tmp_path / "records" / "r1.json").read_text())
    assert on_disk == record and record["run_id"] == "r1"
    errors = spark.read.json(f"{tmp_path}/errors/r1").collect()
    assert len(errors) == record["errors"] >= 1 and any(r["source"] == "c.yaml" and r["stage"] == "parse" for r in errors)
    with pytest.raises(FileExistsError):
        knowledge.ingest(some, table, F.lit(1).cast("long"), str(tmp_path), "r1")


def test_nothing_to_index(spark, tmp_path):
    table = spark.createDataFrame([], schemas.API_DOCUMENT)
    built, record = knowledge.ingest(files(spark), table, F.lit(1).cast("long"), str(tmp_path), "r1")
    assert built.count() == 0 and record["status"] == "failed" and record["parsed"] == record["errors"] == 0
    _, dry = knowledge.ingest(files(spark, ("a.yaml", document("a"))), table, F.lit(1).cast("long"), str(tmp_path), "r2", dry_run=True)
    assert dry["dry_run"] and dry["status"] in ("dry_run", "failed")
