"""Connectors: where documents of a source come from, by name.

A connector is a function (spark, options) -> DataFrame of (uri, html, fetched_at). Web crawling is left to other
programs; ``pages`` reads what they have stored, ``folder`` reads files. Others are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Connector = Callable[[SparkSession, dict], DataFrame]
CONNECTORS: dict[str, Connector] = {}


def connector(name: str):
    def add(function: Connector) -> Connector:
        CONNECTORS[name] = function
        return function

    return add


def load(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in CONNECTORS:
        raise KeyError(f"no connector {name}; there are {sorted(CONNECTORS)}")
    return CONNECTORS[name](spark, options)


@connector("pages")
def stored_pages(spark: SparkSession, options: dict) -> DataFrame:
    """A Parquet table with url and html."""
    return spark.read.parquet(options["path"]).select(F.col("url").alias("uri"), "html", F.lit(None).cast("timestamp").alias("fetched_at"))


@connector("folder")
def folder(spark: SparkSession, options: dict) -> DataFrame:
    """HTML files below a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", options.get("glob", "*.html")).load(options["path"])
    return found.select(F.col("path").alias("uri"), F.col("content").cast("string").alias("html"), F.col("modificationTime").alias("fetched_at"))
