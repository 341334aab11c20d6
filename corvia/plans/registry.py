"""The queries of this library and their DuckDB twins, by name.

A query takes (spark, sf_dir) and runs an operator over whole tables; its twin gives the same rows in SQL. The driver's
tables stand in for the tables of a knowledge system: documents for its documents (source as namespace, lang as
language), embeddings for vectors, lineitem for relations, events for hits, orders and customer for states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL twin if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from corvia.plans import catalog_queries, graph_queries, retrieval_queries, state_queries, stream_queries, text_queries  # noqa: E402, F401
