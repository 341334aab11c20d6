import hashlib
import os

import pytest
from pyspark.sql import functions as F

from corvia.operators import sync
from corvia.operators.apply import RunExists, Runs, apply_actions
from corvia.operators.state import NotFound


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture
def runs(spark, tmp_path):
    return Runs(spark, f"{tmp_path}/runs", f"{tmp_path}/work")


def plan(runs, now, failed=()):
    """Decide on documents {id: text} against the last state and the files that are there."""
    spark = runs.spark
    parsed = spark.createDataFrame([(d, f"https://h/{d}", sha(t), sha(t)) for d, t in now.items()], "document_id string, canonical_uri string, content_hash string, file_hash string")
    lying = []
    for d in now:
        path = f"{runs.workspace}/{d}.md"
        if os.path.exists(path):
            lying.append((d, sha(open(path).read()), False))
    files = spark.createDataFrame(lying, "document_id string, current_hash string, same_content boolean")
    texts = spark.createDataFrame([(d, f"{d}.md", t) for d, t in now.items()], "document_id string, target_path string, text string")
    bad = spark.createDataFrame([(f,) for f in failed], "document_id string")
    return sync.decide(parsed, runs.state(), files, failed=bad, missing=runs.state().select("document_id").join(parsed, "document_id", "left_anti").join(bad, "document_id", "left_anti")), texts


def outcome(df):
    return {r["document_id"]: (r["outcome"], r["reason"]) for r in df.collect()}


def test_a_killed_run_is_taken_up(runs):
    now = {f"d{i}": f"text {i}" for i in range(40)}
    decided, texts = plan(runs, now)
    with runs.lock("r1"):
        actions = runs.begin("r1", decided, texts)
        with pytest.raises(RunExists):
            runs.begin("r1", decided, texts)

        # The run dies: some tasks have written their files, none has told so.
        apply_actions(actions.where("document_id < 'd2'"), runs.workspace).write.format("noop").mode("overwrite").save()
        early = {d: os.stat(f"{runs.workspace}/{d}.md").st_mtime_ns for d in now if d < "d2"}
        assert early and not os.path.exists(f"{runs.workspace}/d5.md") and runs.state().count() == 0

        found = runs.apply("r1")
        assert outcome(found) == {d: ("settled" if d in early else "written", None) for d in now}
        assert {d: os.stat(f"{runs.workspace}/{d}.md").st_mtime_ns for d in early} == early
        again = runs.apply("r1")
        assert set(outcome(again).values()) == {("settled", None)}
        runs.finish("r1", decided, found)
    assert {r["document_id"]: (r["file_hash"], r["relative_path"]) for r in runs.state().collect()} == {d: (sha(t), f"{d}.md") for d, t in now.items()}
    assert all(open(f"{runs.workspace}/{d}.md").read() == t for d, t in now.items())
    assert runs.manifest()["status"] == "succeeded" and runs.manifest()["added"] == 40
    assert not [n for n in os.listdir(runs.workspace) if n.endswith(".tmp")]


def test_backups_failures_and_counts(runs):
    runs.finish("r1", *go(runs, "r1", {"a": "1", "b": "1", "c": "1", "e": "1"}))
    with open(f"{runs.workspace}/b.md", "w") as f:
        f.write("edited by hand")
    decided, texts = plan(runs, {"a": "2", "b": "1", "d": "1"}, failed=["e"])
    runs.begin("r2", decided, texts)
    os.remove(f"{runs.staging('r2')}/d.md")
    found = runs.apply("r2")
    assert outcome(found) == {"a": ("written", None), "b": ("written", None), "d": ("failed", "staged file is missing")}
    backups = f"{runs.folder}/backups/r2"
    assert open(f"{backups}/a.md").read() == "1" and open(f"{backups}/b.md").read() == "edited by hand"
    assert outcome(runs.apply("r2"))["a"] == ("settled", None) and open(f"{backups}/a.md").read() == "1"
    state = {r["document_id"]: (r["content_hash"], r["missing_count"]) for r in runs.finish("r2", decided, found).collect()}
    assert state == {"a": (sha("2"), 0), "b": (sha("1"), 0), "c": (sha("1"), 1), "e": (sha("1"), 0)}
    assert runs.manifest()["status"] == "partial" and runs.manifest(1)["run_id"] == "r1"
    assert {r["document_id"] for r in runs.state(1).collect()} == {"a", "b", "c", "e"}


def go(runs, run_id, now):
    decided, texts = plan(runs, now)
    runs.begin(run_id, decided, texts)
    return decided, runs.apply(run_id)


def test_paths_that_lead_elsewhere(runs, tmp_path):
    decided, texts = plan(runs, {"a": "1", "b": "1"})
    texts = texts.withColumn("target_path", F.when(F.col("document_id") == "b", "../b.md").otherwise(F.col("target_path")))
    runs.begin("r1", decided, texts)
    assert outcome(runs.apply("r1"))["b"][0] == "failed" and not os.path.exists(f"{tmp_path}/b.md")
    with pytest.raises(NotFound):
        runs.journal("r9")


def test_two_runs_of_one_state(runs):
    one, two = go(runs, "r1", {"a": "1"}), go(runs, "r2", {"a": "1"})
    number = runs.states.last() + 1
    runs.finish("r1", *one)
    runs.states.last = lambda: number - 1  # what the second run had read
    with pytest.raises(sync.StateMoved):
        runs.finish("r2", *two)


def test_nothing_to_do(runs):
    decided, texts = plan(runs, {})
    runs.begin("r1", decided, texts)
    assert runs.apply("r1").count() == 0 and runs.finish("r1", decided, runs.apply("r1")).count() == 0
