"""Knowledge updates as a stream with state for each document.

A document's content hash, the fingerprint of what derived knowledge from it, its revision number and how often it was
missed lie in a state store, one value per key: a batch of n documents reads and writes n values, whatever the number of
documents that are known. Rows of one document are taken in their order of time. What can't be processed is an outcome of its
own, leaves the state as it was and doesn't touch other documents, so it is tried again when the document comes again.
A timer misses documents that don't come any more. Rows go through Python as rows: a key has few, and a frame for each key
costs far more than what is done with it.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvia.operators.sync import MISSING_RUNS

STATE = "content_hash string, fingerprint string, revision_number int, missing_count int, seen_at timestamp"
OUTCOME = "document_id string, action string, revision_number int, missing_count int, result string, issue string, at timestamp"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Updates(StatefulProcessor):
    """The outcome of each row (document_id, content_hash, fingerprint, text, updated_at).

    ``extract`` makes a result from a text; whatever it raises is the outcome needs_review with an issue. A text of null
    says that the document is gone: it is missing, and archived_candidate from the third time on. With ``patience``,
    so is a document that hasn't come for so long (in event time).
    """

    def __init__(self, extract: Callable[[str], str], patience: datetime.timedelta | None = None):
        self.extract, self.patience = extract, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("document", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        before, out = held, []
        for row in sorted(rows, key=lambda r: (r.updated_at, r.content_hash is None, r.content_hash or "")):
            at = _local(row.updated_at)
            if row.text is None:
                held, outcome = self._missed(held, at)
            else:
                held, outcome = self._seen(held, row, at)
            out.append(_OUTCOME(key[0], *outcome, at.astimezone()))
        if held is not None and held != before:
            self.state.update(held)
        if held is not None and self.patience:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((held[4] + self.patience).timestamp() * 1000))
        yield from out

    def _seen(self, held: tuple | None, row, at: datetime.datetime) -> tuple[tuple | None, tuple]:
        if held is not None and (held[0], held[1]) == (row.content_hash, row.fingerprint):
            return (*held[:3], 0, max(held[4], at)), ("restored" if held[3] else "unchanged", held[2], 0, None, None)
        number = 1 if held is None else held[2] + 1
        try:
            result = self.extract(row.text)
        except Exception as e:  # one document's failure is its own
            return held, ("needs_review", number - 1, held[3] if held else 0, None, f"{type(e).__name__}: {str(e)[:200]}")
        return (row.content_hash, row.fingerprint, number, 0, at), ("created" if held is None else "updated", number, 0, result, None)

    def _missed(self, held: tuple | None, at: datetime.datetime) -> tuple[tuple | None, tuple]:
        if held is None:
            return None, ("unknown", 0, 0, None, None)
        n = held[3] + 1
        return (*held[:3], n, at), ("archived_candidate" if n >= MISSING_RUNS else "missing", held[2], n, None, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        held, outcome = self._missed(self.state.get(), at)
        if held is None:
            return
        self.state.update(held)
        if held[3] < MISSING_RUNS:
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + int(self.patience.total_seconds() * 1000))
        yield _OUTCOME(key[0], *outcome, at.astimezone())

    def close(self) -> None:
        pass


_OUTCOME = Row(*[f.split()[0] for f in OUTCOME.split(", ")])


def _local(at: datetime.datetime) -> datetime.datetime:
    """The same moment as states hold it: the worker's own time, without a zone."""
    return at.astimezone().replace(tzinfo=None) if at.tzinfo else at


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of streams that start from now on: on disk and in the checkpoint, not in the executors' memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def outcomes(stream: DataFrame, extract: Callable[[str], str], patience: datetime.timedelta | None = None, late: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """(document_id, action, revision_number, missing_count, result, issue, at) for each row of the stream.

    known: states (document_id, and those of STATE) to begin with, from a table; they are read when the stream is new.
    """
    rows = stream.select("document_id", "content_hash", "fingerprint", "text", "updated_at")
    if patience:
        rows = rows.withWatermark("updated_at", late)
    first = known.groupBy("document_id") if known is not None else None
    processor = Updates(extract, patience) if known is None else Continued(extract, patience)
    return rows.groupBy("document_id").transformWithState(processor, OUTCOME, "Append", "EventTime" if patience else "None", first)


class Continued(Updates):
    """Updates that begin with the states of a table."""

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        held, row = self.state.get(), initialState  # of several states the last revision
        if held is None or row.revision_number >= held[2]:
            self.state.update((row.content_hash, row.fingerprint, row.revision_number, row.missing_count, _local(row.seen_at)))


def start_updates(found: DataFrame, sink: str, checkpoint: str):
    """Write outcomes to a Parquet table, each once, until what is there now is read."""
    return found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
