"""Runs that write documents: staged files, a journal, an apply that can be taken up again, the state and the manifest.

What a run will do is a journal that is written before anything is touched. Tasks then back up each target and rename a
copy of its staged file into place. Whether an action is done is told by the target's hash alone, so a run that was
killed is taken up by applying its journal again: what lies there already isn't written twice, whoever was lost and
whenever. The state takes the entries of actions that are done, and no others.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators import sync
from corvia.operators.state import NotFound
from corvia.sources import files
from corvia.sources.log import Lock, Log, create_once, read_text

#: What may come of an action: written now, or there already; or a reason why not.
DONE = ["written", "settled"]
OUTCOME = "document_id string, outcome string, reason string"
STATE = "document_id string, canonical_uri string, content_hash string, file_hash string, missing_count int, relative_path string"


class RunExists(RuntimeError):
    """A run of that id has a journal."""


def apply_actions(actions: DataFrame, workspace: str) -> DataFrame:
    """(document_id, outcome, reason) of actions (document_id, target_path below the workspace, staging_path,
    backup_path, file_hash), done by the tasks that have them."""

    def of(parts):
        from corvia.sources import places

        fs, root = places.at(workspace)

        def one(target_path: str, staging: str, backup: str | None, wanted: str) -> str:
            target = f"{root}/{target_path}"
            there = places.digest(fs, target)
            if there == wanted:
                return "settled"
            source = places.at(staging)
            if not places.is_file(*source):
                raise ValueError("staged file is missing")
            if there is not None:
                if backup is None:
                    raise ValueError("target has no backup path")
                kept = places.at(backup)
                if not places.is_file(*kept):
                    # What is copied may be another attempt's work by now: then there is nothing left to do.
                    temporary, read = places.copy((fs, target), kept)
                    if read == wanted:
                        kept[0].delete_file(temporary)
                        return "settled"
                    places.take_place(kept[0], temporary, kept[1])
            temporary, read = places.copy(source, (fs, target))
            if read != wanted:
                fs.delete_file(temporary)
                raise ValueError("staged file is another one")
            places.take_place(fs, temporary, target)
            return "written"

        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                try:
                    out.append((row.document_id, one(row.target_path, row.staging_path, row.backup_path, row.file_hash), None))
                except (OSError, ValueError) as e:
                    out.append((row.document_id, "failed", str(e)))
            yield pd.DataFrame(out, columns=["document_id", "outcome", "reason"])

    columns = ["document_id", "target_path", "staging_path", "backup_path", "file_hash"]
    return actions.select(*columns).mapInPandas(of, OUTCOME)


class Runs:
    """Runs of one source below a shared folder: journals, outcomes, states and manifests; documents go to a workspace."""

    def __init__(self, spark: SparkSession, folder: str, workspace: str):
        self.spark, self.folder, self.workspace = spark, folder.rstrip("/"), workspace.rstrip("/")
        self.states = Log(spark, f"{self.folder}/states")

    def lock(self, run_id: str, patience: float = 0.0) -> Lock:
        return Lock(self.spark, f"{self.folder}/run.lock", run_id, patience)

    def staging(self, run_id: str) -> str:
        return f"{self.folder}/staging/{run_id}"

    def begin(self, run_id: str, decided: DataFrame, texts: DataFrame) -> DataFrame:
        """Stage the texts (document_id, target_path, text) of what ``sync.decide`` says is to be written, and write the
        journal; it is complete or not there, and a run has one."""
        if read_text(self.spark, f"{self.folder}/journals/{run_id}/begun") is not None:
            raise RunExists(run_id)
        wanted = decided.where(F.col("operation").isin(sync.WRITTEN))
        staged = files.write_files(wanted.select("document_id").join(texts, "document_id"), self.staging(run_id), "target_path")
        staged.write.mode("overwrite").parquet(f"{self.folder}/journals/{run_id}/staged")
        rows = decided.join(texts.select("document_id", "target_path"), "document_id", "left")
        actions = sync.journal(rows, run_id, F.col("target_path"), f"{self.folder}/staging", f"{self.folder}/backups")
        actions = actions.join(rows.select("document_id", "missing_count"), "document_id")
        actions.write.mode("overwrite").parquet(f"{self.folder}/journals/{run_id}/actions")
        if not create_once(self.spark, f"{self.folder}/journals/{run_id}/begun", json.dumps({"run_id": run_id})):
            raise RunExists(run_id)
        return self.journal(run_id)

    def journal(self, run_id: str) -> DataFrame:
        if read_text(self.spark, f"{self.folder}/journals/{run_id}/begun") is None:
            raise NotFound(f"no journal of run {run_id}")
        return self.spark.read.parquet(f"{self.folder}/journals/{run_id}/actions")

    def _safe(self, run_id: str, actions: DataFrame) -> DataFrame:
        """The journal with the reason why an action may not be done: its paths lead elsewhere."""
        from corvia.functions.text import safe_relative_path

        def under(column: str, root: str):
            return F.col(column).startswith(f"{root}/{run_id}/") & ~F.col(column).rlike(r"(^|/)\.\.(/|$)")

        backup = F.col("backup_path").isNull() | under("backup_path", f"{self.folder}/backups")
        why = F.when(~under("staging_path", f"{self.folder}/staging"), "staging path is not the run's").when(~safe_relative_path(F.col("target_path")), "target path is not in the workspace").when(~backup, "backup path is not the run's")
        return actions.withColumn("problem", why)

    def apply(self, run_id: str) -> DataFrame:
        """Do what of the run's journal isn't done, and note what came of it; the same call resumes a run."""
        actions = self._safe(run_id, self.journal(run_id))
        tried = apply_actions(actions.where("problem IS NULL"), self.workspace)
        refused = actions.where("problem IS NOT NULL").select("document_id", F.lit("failed").alias("outcome"), F.col("problem").alias("reason"))
        out = f"{self.folder}/outcomes/{run_id}/{uuid.uuid4().hex}"
        tried.union(refused).write.parquet(out)
        return self.spark.read.schema(OUTCOME).parquet(out)

    def state(self, number: int | None = None) -> DataFrame:
        """The source's state after the last run that was finished, or an earlier one; empty before the first."""
        entry = self.states.entry(self.states.last() if number is None else number)
        if entry is None:
            return self.spark.createDataFrame([], STATE)
        try:
            return self.spark.read.schema(STATE).parquet(f"{self.folder}/{entry['rows']}")
        except AnalysisException as e:
            raise NotFound(entry["rows"]) from e

    def finish(self, run_id: str, decided: DataFrame, outcomes: DataFrame) -> DataFrame:
        """The next state, and the run's manifest; both are there once the manifest is.

        Documents that were written have their new entry, those that failed (also in reading) the old one or none;
        missing ones keep theirs with their count, archived ones too.
        """
        found = decided.join(outcomes, "document_id", "left").join(self.journal(run_id).select("document_id", "target_path"), "document_id", "left")
        failed = (F.col("operation") == "failed") | (F.col("operation").isin(sync.WRITTEN) & ~F.coalesce(F.col("outcome").isin(DONE), F.lit(False)))
        found = found.withColumn("operation", F.when(failed, "failed").otherwise(F.col("operation")))
        old = self.state()
        wrote = F.col("operation").isin(sync.WRITTEN)
        pick = lambda new, was: F.when(wrote | (F.col("operation") == "unchanged"), F.coalesce(new, was)).otherwise(F.col(was))
        fresh = found.where("operation <> 'failed'").join(old.select("document_id", F.col("relative_path").alias("_path")), "document_id", "left")
        entries = fresh.select("document_id", pick("new_uri", "old_uri").alias("canonical_uri"), pick("new_hash", "old_hash").alias("content_hash"), pick("new_file", "old_file").alias("file_hash"), "missing_count", F.when(wrote, F.col("target_path")).otherwise(F.col("_path")).alias("relative_path"))
        kept = old.join(fresh.select("document_id"), "document_id", "left_anti")
        rows, number = f"state-rows/{run_id}-{uuid.uuid4().hex}", self.states.last() + 1
        entries.unionByName(kept).write.parquet(f"{self.folder}/{rows}")
        row = sync.manifest(found, run_id, "apply").first().asDict()
        if not self.states.append(number, {"run_id": run_id, "rows": rows, "manifest": row}):
            raise sync.StateMoved(f"another run has finished as number {number}")
        return self.state(number)

    def manifest(self, number: int | None = None) -> dict | None:
        """What the last finished run, or an earlier one, did."""
        entry = self.states.entry(self.states.last() if number is None else number)
        return entry and entry["manifest"]
