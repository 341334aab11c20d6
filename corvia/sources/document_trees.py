"""Trees of documents as a data source: ``spark.read.format("documents")`` and ``df.write.format("documents")``.

Reading lists the tree once and deals its files into splits of about equally many bytes, so that neither many small
files nor a few long ones make the number of tasks; conditions on path and length are applied to the list, before any
file is opened. Writing puts each row's text into a file of its own, first below a folder of the job: files take their
places when all tasks have done theirs, and none does if one fails. What a task has written is in a list of its own, and
the driver is sent the list's name.

Options: path; extensions (by commas), splitBytes, maxBytes (longer files are left out) in reading.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "path string, length long, modified timestamp, text string"
SPLIT, MOST = 32 << 20, 10 << 20
#: What opening a file costs, in bytes, when splits are planned.
OPEN = 64 << 10
STAGING = "_writing"

CHECKS = {
    EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a,
}


@dataclass
class Split(InputPartition):
    files: list[tuple[str, int, float]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = tuple(e.strip() for e in options.get("extensions", ".md,.markdown,.yaml,.yml,.txt").split(","))
        self.split, self.most = int(options.get("splitbytes", options.get("splitBytes", SPLIT))), int(options.get("maxbytes", options.get("maxBytes", MOST)))
        self.checks: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on path and length are kept for the list of files; the rest goes back to Spark."""
        for f in filters:
            if type(f) in CHECKS and f.attribute in (("path",), ("length",)):
                self.checks.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def _listed(self) -> list[tuple[str, int, float]]:
        from pyarrow import fs as pafs

        from corvia.sources import places

        fs, root = places.at(self.root)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            path = info.path.removeprefix(root).lstrip("/")
            if info.type == pafs.FileType.File and path.endswith(self.extensions) and not path.startswith((STAGING, ".")) and "/." not in path and info.size <= self.most:
                values = {"path": path, "length": info.size}
                if all(CHECKS[kind](values[column], value) for column, kind, value in self.checks):
                    found.append((path, info.size, info.mtime_ns / 1e9))
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        splits, held, size = [], [], 0
        for file in self._listed():
            if held and size + file[1] + OPEN > self.split:
                splits.append(Split(held))
                held, size = [], 0
            held.append(file)
            size += file[1] + OPEN
        return [*splits, Split(held)] if held else splits or [Split([])]

    def read(self, partition: Split) -> Iterator[tuple]:
        from corvia.sources import places

        fs, root = places.at(self.root)
        for path, length, modified in partition.files:
            with fs.open_input_stream(f"{root}/{path}") as stream:
                raw = stream.read()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = None  # no UTF-8
            yield path, length, datetime.datetime.fromtimestamp(modified), text


@dataclass
class Written(WriterCommitMessage):
    """The list that a task has written of its files and their places; the message holds its name only."""

    listed: str


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from corvia.sources import places

        fs, root = places.at(self.root)
        folder = f"{root}/{STAGING}/{self.job}"
        fs.create_dir(folder, recursive=True)
        listed = f"{folder}/{uuid.uuid4().hex}.list"
        with fs.open_output_stream(listed) as out:
            for own, target in self._put(fs, root, iterator):
                out.write(json.dumps([own, target]).encode() + b"\n")
        return Written(listed)

    def _put(self, fs, root: str, iterator: Iterator[Row]) -> Iterator[tuple[str, str]]:
        for row in iterator:
            path = row["path"]
            if not path or path.startswith("/") or ".." in path.split("/") or row["text"] is None:
                raise ValueError(f"unsafe path or no text: {path!r}")
            own = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(row["text"].encode())
            yield own, f"{root}/{path}"

    @staticmethod
    def _listed(fs, messages: list[Written | None]) -> Iterator[tuple[str, str]]:
        for m in messages:
            if m:
                with fs.open_input_file(m.listed) as stream, io.TextIOWrapper(stream, encoding="utf-8") as lines:
                    yield from map(json.loads, lines)

    def _clear(self) -> None:
        from pyarrow import fs as pafs

        from corvia.sources import places

        fs, root = places.at(self.root)
        for folder in (f"{root}/{STAGING}/{self.job}", f"{root}/{STAGING}"):
            there = fs.get_file_info(folder).type == pafs.FileType.Directory
            if there and (folder.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(folder))):
                fs.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """All files are there: they take their places. Tasks that were tried again have told of their last try only."""
        from pyarrow import fs as pafs

        from corvia.sources import places

        fs, root = places.at(self.root)
        seen: set[bytes] = set()
        for _, target in self._listed(fs, messages):
            mark = hashlib.blake2b(target.encode(), digest_size=16).digest()
            if mark in seen:
                self._clear()
                raise ValueError("a path occurs twice")
            seen.add(mark)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if info.base_name != STAGING:
                    (fs.delete_dir if info.type == pafs.FileType.Directory else fs.delete_file)(info.path)
        folders: set[str] = set()
        for own, target in self._listed(fs, messages):
            if (folder := target.rpartition("/")[0]) not in folders:
                fs.create_dir(folder, recursive=True)
                folders.add(folder)
            places.take_place(fs, own, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class DocumentTrees(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TreeReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentTrees)
