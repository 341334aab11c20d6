"""Files that exist once: numbered logs, locks and markers in a shared folder.

A file is written in full under a name of its own and then takes its place only if nothing is there: by a hard link on a
local file system, by a rename on others (which HDFS refuses where the target exists). Of several writers exactly one
gets the place. Stores without such a rename need a committer of their own.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import AbstractContextManager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file if there is none; False if there is one."""
    at, fs = _path(spark, path)
    parent = at.getParent()
    fs.mkdirs(parent)
    beside = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(text.encode())
    out.close()
    try:
        if fs.getScheme() != "file":
            return not fs.exists(at) and fs.rename(beside, at)
        local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(local(fs.makeQualified(at)), local(fs.makeQualified(beside)))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        fs.delete(beside, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    at, fs = _path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    at, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


class Log:
    """Entries (JSON) numbered from 1; each number is taken once, so that of two writers who have read the same end of
    the log one appends and the other learns that it was late. What comes before a summary need not be read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self, kind: str) -> list[int]:
        return [int(n.split(".")[0]) for n in names(self.spark, self.folder) if n.endswith(kind) and n[0].isdigit()]

    def last(self) -> int:
        return max(self._numbers(".entry.json"), default=0)

    def _name(self, number: int, kind: str) -> str:
        return f"{self.folder}/{number:020d}{kind}"

    def entry(self, number: int) -> dict | None:
        text = read_text(self.spark, self._name(number, ".entry.json"))
        return None if text is None else json.loads(text)

    def append(self, number: int, entry: dict) -> bool:
        return create_once(self.spark, self._name(number, ".entry.json"), json.dumps(entry))

    def summarize(self, number: int, summary: dict) -> bool:
        """A summary of all entries up to a number."""
        return create_once(self.spark, self._name(number, ".summary.json"), json.dumps(summary))

    def since_summary(self, number: int, entries: bool = True) -> tuple[dict | None, list[dict]]:
        """The last summary at or before a number, and (if they are asked for) the entries after it up to the number."""
        at = max((n for n in self._numbers(".summary.json") if n <= number), default=0)
        summary = read_text(self.spark, self._name(at, ".summary.json")) if at else None
        return (json.loads(summary) if summary else None), [self.entry(n) for n in range(at + 1, number + 1)] if entries else []


class LockHeld(RuntimeError):
    """Another run holds the lock."""


class Lock(AbstractContextManager):
    """One run at a time in a folder; the file says whose. A lock that a lost driver left must be deleted by hand."""

    def __init__(self, spark: SparkSession, path: str, owner: str, patience: float = 0.0):
        self.spark, self.path, self.owner, self.patience = spark, path, owner, patience

    def __enter__(self) -> Lock:
        until = time.monotonic() + self.patience
        while not create_once(self.spark, self.path, json.dumps({"owner": self.owner, "since": time.time()})):
            if time.monotonic() >= until:
                raise LockHeld(f"{self.path}: {read_text(self.spark, self.path)}")
            time.sleep(min(0.2, max(0.01, until - time.monotonic())))
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, self.path)
