"""Tables whose files hold ranges of a key, and where a change rewrites only the files that hold its keys.

A log says which files are live, with the smallest and the largest key of each. An upsert finds the files of its keys,
merges these files alone, and commits their replacements; readers of an earlier version go on reading the old files. Of
two writers who read the same version one is late and may try again. Keys that begin with their scope keep a scope's
rows in few files, so that rebuilding a scope touches these and the ones at its edges.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.operators.catalog import Conflict
from corvia.sources.log import Log
from corvia.tables import durable

#: Rows of a file, about; versions after which the list of files is put together.
ROWS, SUMMARY = 100_000, 32
#: Parts of a file's name: the write's folder, the slot's and its own.
DEPTH = 3


class RangedTable:
    """A table below a shared folder; ``key`` is a string column without nulls, unique."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, key: str, rows: int = ROWS):
        self.spark, self.folder, self.key, self.rows = spark, folder.rstrip("/"), key, rows
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.log = Log(spark, f"{self.folder}/log")

    def version(self) -> int:
        return self.log.last()

    def files(self, version: int | None = None) -> dict[str, dict]:
        """The live files at a version, each with lo, hi and rows."""
        summary, entries = self.log.since_summary(self.version() if version is None else version)
        live = dict(summary["files"]) if summary else {}
        for e in entries:
            for name in e["removed"]:
                live.pop(name)
            live |= e["added"]
        return live

    def _read(self, names: list[str]) -> DataFrame:
        """The rows of files, with the file in ``_file``."""
        if not names:
            return self.spark.createDataFrame([], self.schema).withColumn("_file", F.lit(None).cast("string"))
        path = F.split("_metadata.file_path", "/")
        found = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{n}" for n in sorted(names)])
        return found.withColumn("_file", F.array_join(F.slice(path, -DEPTH, F.lit(DEPTH)), "/"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(list(self.files(version))).drop("_file")

    def between(self, lo: str, hi: str, version: int | None = None) -> DataFrame:
        """Rows with lo <= key < hi; files of other ranges aren't opened."""
        names = [n for n, f in self.files(version).items() if f["lo"] < hi and f["hi"] >= lo]
        return self._read(names).where((F.col(self.key) >= lo) & (F.col(self.key) < hi)).drop("_file")

    def _write(self, rows: DataFrame, n: int) -> dict[str, dict]:
        """Write rows (with ``_slot``) as files of ranges, each of one slot; their names, bounds and numbers of rows.

        A slot is the range of a file that is replaced: no new file reaches over one that stays.
        """
        part = uuid.uuid4().hex
        order = ["_slot", self.key]
        placed = rows.select(*self.schema.names, "_slot").repartitionByRange(max(1, -(-n // self.rows)), *order).sortWithinPartitions(*order)
        placed.write.partitionBy("_slot").parquet(f"{self.folder}/data/{part}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{part}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [f"{part}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory()]
        written = self._read(folders)
        bounds = written.groupBy("_file").agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi"), F.count(F.lit(1)).alias("rows"))
        return {r["_file"]: {"lo": r["lo"], "hi": r["hi"], "rows": r["rows"]} for r in bounds.collect()}

    def _commit(self, base: int, removed: list[str], added: dict[str, dict]) -> int:
        if not self.log.append(base + 1, {"removed": removed, "added": added}):
            raise Conflict(f"the table is at version {self.version()}")
        if (base + 1) % SUMMARY == 0:
            self.log.summarize(base + 1, {"files": self.files(base + 1)})
        return base + 1

    def _file_of(self, keys: DataFrame, live: dict[str, dict]) -> DataFrame:
        """(key, file): the live file whose range a key falls in or follows; the first one for keys before all."""
        order = sorted((f["lo"].encode(), n) for n, f in live.items())
        lows, names = [lo for lo, _ in order], [n for _, n in order]
        shared = self.spark.sparkContext.broadcast((lows, names))  # one entry a file

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lows, names = shared.value
            for batch in batches:
                own = [names[max(0, bisect_right(lows, k.encode()) - 1)] for k in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["key", "file"])

        return keys.mapInArrow(find, "key string, file string")

    def upsert(self, changes: DataFrame, deleted: Column | None = None) -> tuple[int, list[str]]:
        """The next version and the files that were rewritten, after rows of changes replace those of their keys or come
        anew; those for which ``deleted`` holds go. A key may be in changes once."""
        base, live = self.version(), self.files()
        changes = durable(changes.withColumn("_gone", F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)))
        n = changes.count()
        if not n:
            return base, []
        if live:
            falls = durable(self._file_of(changes.select(F.col(self.key).alias("key")), live))
            touched = sorted(r["file"] for r in falls.select("file").distinct().collect())
            changes = changes.join(falls.withColumnsRenamed({"key": self.key, "file": "_file"}), self.key)
        else:
            touched, changes = [], changes.withColumn("_file", F.lit("").cast("string"))
        kept = self._read(touched).join(changes.select(self.key), self.key, "left_anti")
        merged = kept.unionByName(changes.where("NOT _gone").drop("_gone").select(*kept.columns))
        number = {t: i for i, t in enumerate(touched)} or {"": 0}
        slots = self.spark.createDataFrame(list(number.items()), "_file string, _slot int")
        return self._commit(base, touched, self._write(merged.join(slots, "_file"), sum(live[t]["rows"] for t in touched) + n)), touched

    def replace(self, lo: str, hi: str, rows: DataFrame) -> tuple[int, list[str]]:
        """The next version and the files that were rewritten, after all rows with lo <= key < hi give way to others."""
        base, live = self.version(), self.files()
        touched = sorted(n for n, f in live.items() if f["lo"] < hi and f["hi"] >= lo)
        rows = durable(rows.select(*self.schema.names))
        if not rows.where((F.col(self.key) < lo) | (F.col(self.key) >= hi)).isEmpty():
            raise ValueError(f"rows outside {lo!r} to {hi!r}")
        kept = self._read(touched).where((F.col(self.key) < lo) | (F.col(self.key) >= hi))
        return self._commit(base, touched, self._write(kept.drop("_file").unionByName(rows).withColumn("_slot", F.lit(0)), kept.count() + rows.count())), touched
