"""Document frequencies that take changes: signed counts per token and version, merged when they are read.

A version adds the tokens of documents that came and takes those of documents that went; a changed document is both.
Only the documents that change are read. Versions are numbered by a log, so that of two writers one is late, and are put
together from time to time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.functions.text import tokens
from corvia.operators.catalog import Conflict
from corvia.sources.log import Log

#: Versions after which counts are put together.
SUMMARY = 16
COUNT = "token string, n long"


def signed_counts(changes: DataFrame) -> DataFrame:
    """(token, n) of changes (text, sign): in how many more documents each token is; the row without a token counts documents."""
    held = changes.select("sign", F.explode(F.concat(F.array_distinct(tokens(F.col("text"))), F.array(F.lit(None).cast("string")))).alias("token"))
    return held.groupBy("token").agg(F.sum("sign").cast("long").alias("n")).where("n <> 0")


class Frequencies:
    """The frequencies of one corpus, below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, f"{self.folder}/log")

    def version(self) -> int:
        return self.log.last()

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, base: int | None = None) -> int:
        """The next version, after documents (text) that came and that went; a conflict if base isn't the last one."""
        sides = [d.select("text", F.lit(sign).alias("sign")) for d, sign in ((added, 1), (removed, -1)) if d is not None]
        if not sides:
            return self.version()
        number, part = (self.version() if base is None else base) + 1, uuid.uuid4().hex
        changes = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
        signed_counts(changes).write.parquet(f"{self.folder}/parts/{part}")
        if not self.log.append(number, {"part": part}):
            raise Conflict(f"the frequencies are at version {self.version()}")
        if number % SUMMARY == 0:
            self.summarize(number)
        return number

    def _merged(self, version: int | None) -> DataFrame:
        summary, entries = self.log.since_summary(self.version() if version is None else version)
        folders = [f"{self.folder}/parts/{e['part']}" for e in ([summary] if summary else []) + entries]
        rows = self.spark.read.schema(COUNT).parquet(*folders) if folders else self.spark.createDataFrame([], COUNT)
        return rows.groupBy("token").agg(F.sum("n").alias("n")).where("n <> 0")

    def current(self, version: int | None = None) -> tuple[DataFrame, int]:
        """(token, df) at a version, and the number of documents."""
        merged = self._merged(version)
        n = merged.where("token IS NULL").first()
        return merged.where("token IS NOT NULL").select("token", F.col("n").alias("df")), n["n"] if n else 0

    def summarize(self, version: int | None = None) -> None:
        at, part = self.version() if version is None else version, uuid.uuid4().hex
        self._merged(at).write.parquet(f"{self.folder}/parts/{part}")
        self.log.summarize(at, {"part": part})
