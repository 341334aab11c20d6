"""Tables that a plan writes on its way: they cut the lineage, so that a lost executor costs no recomputation beyond them."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset (tests), a temporary folder on a local master, and a
    folder beside the warehouse elsewhere."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.startswith("local["):
        own = spark.sparkContext.applicationId
        if own not in _FOLDERS:
            _FOLDERS[own] = tempfile.mkdtemp(prefix="corvia-")
        return _FOLDERS[own]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own in the shared one; it is removed when the driver ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read back.

    A written table, unlike a checkpoint, is read with its true size (sizes that are estimated from one join to the
    next grow without end in a loop) and only in the columns that are asked for.
    """
    folder = new_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
