import pytest
from pyspark.sql import functions as F
from test_mixing import water

from corvia.llm import mixing as M


def test_targets_of_many_sources(spark):
    sizes = [(i * 7919) % 1000 + 1 for i in range(3000)]
    rows = spark.createDataFrame([(f"0s{i:05d}", s) for i, s in enumerate(sizes)], "_key string, size long").repartition(7)
    found = [r["target"] for r in M.targets(rows).orderBy("_key").collect()]
    assert found == pytest.approx(water(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))]))


def test_one_offset_for_each_source(spark):
    """Copies are those of one offset: the copies along a source are the steps of its rate from that offset."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), 10).alias("text"))
    docs = docs.union(spark.range(500, 900).select("id", F.lit("t"), F.repeat(F.lit("w "), 10)))
    for source, n in (("s", 500), ("t", 400)):
        rows = [r for r in M.mix(docs).collect() if r["source"] == source]
        rate = rows[0]["target"] / rows[0]["source_size"]
        offset = spark.range(1).select(M.unit_hash(F.lit("offset7"), F.lit(f"0{source}"))).first()[0]
        assert sum(r["copies"] for r in rows) == int(n * rate + offset) and {r["copies"] for r in rows} <= {int(rate), int(rate) + 1}
