"""Every query with a SQL twin gives the twin's rows; the others give rows of a stable schema."""

import math

import duckdb
import pytest

from corvia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(names, found, own):
    at = [own.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sql, name):
    found = registry.QUERIES[name](spark, SF)
    collected = [tuple(r) for r in found.collect()]
    assert found.schema == registry.QUERIES[name](spark, SF).schema
    if name in registry.ORACLES:
        want = sql.sql(registry.ORACLES[name])
        assert sorted(found.columns) == sorted(want.columns)
        names = sorted(found.columns)
        assert rows(names, collected, found.columns) == rows(names, want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
