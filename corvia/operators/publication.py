"""A wiki's catalog as a log of commits: revisions that never change, and pointers to the active ones.

Publishing compares and swaps: rows are staged against a version, and the commit takes the next number or is late. A
commit adds a part of revisions and a part of pointer moves; readers pin a version and see the last move of each id up
to it, whatever is written meanwhile. From time to time a summary puts the parts together, so that what a reader opens
doesn't grow with the number of commits.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators.catalog import Conflict, moves, stage
from corvia.operators.state import NotFound
from corvia.sources.log import Log, create_once, delete, names, read_text

#: Commits after which parts are put together.
SUMMARY = 20

REVISION = "kind string, id string, revision_id string, revision_number int, status string, wiki_id string, payload string"
POINTER = "kind string, id string, revision_id string, revision_number int, status string, version long"


class NotPublishable(RuntimeError):
    """Staged rows that were abandoned, or that belong to another wiki."""


class Catalog:
    """The catalog of one wiki below a shared folder."""

    def __init__(self, spark: SparkSession, root: str, wiki_id: str):
        self.spark, self.root, self.wiki_id = spark, f"{root.rstrip('/')}/{wiki_id}", wiki_id
        self.log = Log(spark, f"{self.root}/log")

    def version(self) -> int:
        return self.log.last()

    # Reading

    def _parts(self, kind: str, schema: str, version: int | None) -> DataFrame:
        summary, entries = self.log.since_summary(self.version() if version is None else version)
        parts = [e[kind] for e in ([summary] if summary else []) + entries if e.get(kind)]
        folders = [f"{self.root}/data/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def pointers(self, version: int | None = None) -> DataFrame:
        """(kind, id, revision_id, revision_number, status, version): where each id leads at a version."""
        rest = ["revision_id", "revision_number", "status", "version"]
        moved = self._parts("pointers", POINTER, version).groupBy("kind", "id").agg(F.max_by(F.struct(*rest), "version").alias("_r"))
        return moved.select("kind", "id", "_r.*")

    def revisions(self, version: int | None = None) -> DataFrame:
        """All revisions that were stored up to a version, reachable or not."""
        return self._parts("revisions", REVISION, version)

    def active(self, kind: str, version: int | None = None) -> DataFrame:
        """The revisions of a kind that pointers lead to."""
        at = self.version() if version is None else version
        led = self.pointers(at).where(F.col("kind") == kind).select("kind", "revision_id")
        return self.revisions(at).join(led, ["kind", "revision_id"], "left_semi")

    def source_states(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """The active revisions of the sources (id) that are asked for, through their pointers."""
        return self.active("source", version).join(ids.select("id").distinct(), "id", "left_semi")

    # Staging

    def _staging(self, staging_id: str) -> str:
        return f"{self.root}/staging/{staging_id}"

    def stage(self, operation_id: str, sources: DataFrame, artifacts: DataFrame) -> str:
        """Rows that readers don't see, against the version of now; sources and artifacts have id, revision and wiki columns."""
        staging_id, base = f"{operation_id}-{uuid.uuid4().hex[:12]}", self.version()
        stage(operation_id, sources, artifacts, base).write.parquet(f"{self._staging(staging_id)}/rows")
        create_once(self.spark, f"{self._staging(staging_id)}/entry.json", json.dumps({"operation_id": operation_id, "base": base, "wiki_id": self.wiki_id}))
        return staging_id

    def _entry(self, staging_id: str) -> dict:
        text = read_text(self.spark, f"{self._staging(staging_id)}/entry.json")
        if text is None:
            raise NotFound(f"no staging {staging_id}")
        return json.loads(text)

    def staged(self, staging_id: str) -> DataFrame:
        self._entry(staging_id)
        return self.spark.read.parquet(f"{self._staging(staging_id)}/rows")

    def _decision(self, staging_id: str) -> str | None:
        return read_text(self.spark, f"{self._staging(staging_id)}/decision")

    def _led_to(self, rows: DataFrame) -> bool:
        """Whether the pointers lead to all sources of the rows."""
        sources = rows.where("kind = 'source'").select("kind", "id", "revision_id")
        return not sources.isEmpty() and sources.join(self.pointers(), ["kind", "id", "revision_id"], "left_anti").isEmpty()

    def state(self, staging_id: str) -> str:
        """staged, published, abandoned, or late (another commit took its place)."""
        next_one = self.log.entry(self._entry(staging_id)["base"] + 1)
        if next_one and next_one["staging_id"] == staging_id:
            return "published"
        if (said := self._decision(staging_id)) and said != "publish":
            return "abandoned"
        return "late" if next_one else "staged"

    def publish(self, staging_id: str) -> DataFrame:
        """Store the staged revisions and move the pointers of sources and active artifacts; the active artifacts.

        What is published already is given again. Rows staged against another version than the last are a conflict,
        unless the pointers lead to their sources. Artifacts that wait for review are stored, but nothing leads to them.
        """
        entry, rows = self._entry(staging_id), self.staged(staging_id)
        live = rows.where("kind = 'artifact' AND status = 'active'")
        if (state := self.state(staging_id)) == "published":
            return live
        if state == "abandoned":
            raise NotPublishable(f"{staging_id} was abandoned")
        if not rows.where(~F.col("wiki_id").eqNullSafe(F.lit(self.wiki_id))).isEmpty():
            raise NotPublishable(f"{staging_id} has revisions of another wiki")
        if state == "late":
            return self._late(staging_id, rows, live)
        if not create_once(self.spark, f"{self._staging(staging_id)}/decision", "publish") and self._decision(staging_id) != "publish":
            raise NotPublishable(f"{staging_id} was abandoned")
        version, part = entry["base"] + 1, uuid.uuid4().hex
        kept = [f.split()[0] for f in REVISION.split(", ")]
        fresh = rows.select(*kept).dropDuplicates(["kind", "revision_id"]).join(self.revisions(entry["base"]).select("kind", "revision_id"), ["kind", "revision_id"], "left_anti")
        fresh.select(*kept).write.parquet(f"{self.root}/data/{part}-revisions")
        moves(rows).withColumn("version", F.lit(version).cast("long")).write.parquet(f"{self.root}/data/{part}-pointers")
        if not self.log.append(version, {"staging_id": staging_id, "operation_id": entry["operation_id"], "revisions": f"{part}-revisions", "pointers": f"{part}-pointers"}):
            if (self.log.entry(version) or {}).get("staging_id") != staging_id:
                for kind in ("revisions", "pointers"):
                    delete(self.spark, f"{self.root}/data/{part}-{kind}")
                return self._late(staging_id, rows, live)
        if version % SUMMARY == 0:
            self.summarize(version)
        return live

    def _late(self, staging_id: str, rows: DataFrame, live: DataFrame) -> DataFrame:
        if self._led_to(rows):
            return live
        raise Conflict(f"{staging_id}: the catalog is at version {self.version()}")

    def abandon(self, staging_id: str, reason: str) -> str:
        """Give staged rows up; ``published`` if the pointers lead to their sources all the same. Published rows can't be."""
        if self.state(staging_id) == "published":
            raise NotPublishable(f"{staging_id} is published")
        if self._led_to(self.staged(staging_id)):
            return "published"
        path = f"{self._staging(staging_id)}/decision"
        if not create_once(self.spark, path, f"abandon: {reason}") and self._decision(staging_id) == "publish":
            if self.state(staging_id) != "late":
                raise Conflict(f"{staging_id} is being published")
            delete(self.spark, path)  # its place is taken, so it can't be published any more
            create_once(self.spark, path, f"abandon: {reason}")
        return "abandoned"

    # Upkeep

    def summarize(self, version: int | None = None) -> None:
        """Put all parts up to a version together; readers of any version at or after it open these."""
        at, part = self.version() if version is None else version, uuid.uuid4().hex
        self.pointers(at).write.parquet(f"{self.root}/data/{part}-pointers")
        self.revisions(at).write.parquet(f"{self.root}/data/{part}-revisions")
        self.log.summarize(at, {"staging_id": None, "pointers": f"{part}-pointers", "revisions": f"{part}-revisions"})

    def orphans(self) -> list[str]:
        """Parts that no entry names: those of writers that were lost before their commit, or are at work."""
        held = set()
        for name in names(self.spark, self.log.folder):
            if name.endswith(".json"):
                entry = json.loads(read_text(self.spark, f"{self.log.folder}/{name}"))
                held |= {entry.get("pointers"), entry.get("revisions")}
        return [n for n in names(self.spark, f"{self.root}/data") if n not in held]
