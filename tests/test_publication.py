import threading

import pytest
from pyspark.sql import functions as F

from corvia.operators.catalog import Conflict
from corvia.operators.publication import Catalog, NotPublishable
from corvia.operators.state import NotFound
from corvia.sources.log import Lock, LockHeld, Log, create_once, read_text

SOURCE = "source_id string, source_revision_id string, wiki_id string, revision_number int"
ARTIFACT = "artifact_id string, artifact_revision_id string, wiki_id string, revision_number int, status string"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path), "w")


def staged(catalog, source, *artifacts, wiki="w"):
    spark = catalog.spark
    sources = spark.createDataFrame([(source[0], source[1], wiki, 1)], SOURCE)
    return catalog.stage("op", sources, spark.createDataFrame([(a, r, wiki, n, s) for a, r, n, s in artifacts], ARTIFACT))


def led(catalog, version=None):
    return {(r["kind"][0], r["id"]): r["revision_id"] for r in catalog.pointers(version).collect()}


def test_active_revisions_move_and_readers_pin_a_version(catalog):
    one = staged(catalog, ("s1", "s1.1"), ("a", "a.1", 1, "active"), ("b", "b.1", 1, "pending_review"), ("c", "c.1", 1, "active"), ("c", "c.2", 2, "active"))
    assert catalog.version() == 0 and catalog.state(one) == "staged" and led(catalog) == {}
    assert {r["id"] for r in catalog.publish(one).collect()} == {"a", "c"}
    first = {("s", "s1"): "s1.1", ("a", "a"): "a.1", ("a", "c"): "c.2"}
    assert led(catalog) == first and catalog.state(one) == "published"
    assert catalog.publish(one).count() == 3 and catalog.version() == 1  # given again, nothing new
    catalog.publish(staged(catalog, ("s1", "s1.2"), ("a", "a.2", 2, "active")))
    assert led(catalog, 1) == first and led(catalog)[("a", "a")] == "a.2"
    assert {r["revision_id"] for r in catalog.revisions().where("kind = 'artifact'").collect()} == {"a.1", "b.1", "c.1", "c.2", "a.2"}
    assert {r["revision_id"] for r in catalog.active("artifact").collect()} == {"a.2", "c.2"}
    asked = catalog.spark.createDataFrame([("s1",), ("s9",)], "id string")
    assert [r["revision_id"] for r in catalog.source_states(asked).collect()] == ["s1.2"]


def test_abandoned_foreign_and_unknown_rows(catalog):
    gone = staged(catalog, ("s1", "s1.1"), ("a", "a.1", 1, "active"))
    assert catalog.abandon(gone, "no") == "abandoned" and catalog.state(gone) == "abandoned"
    with pytest.raises(NotPublishable):
        catalog.publish(gone)
    with pytest.raises(NotPublishable):
        catalog.publish(staged(catalog, ("s1", "s1.1"), wiki="other"))
    with pytest.raises(NotFound):
        catalog.publish("nothing")
    done = staged(catalog, ("s1", "s1.1"), ("a", "a.1", 1, "active"))
    twin = staged(catalog, ("s1", "s1.1"), ("a", "a.1", 1, "active"))
    catalog.publish(done)
    with pytest.raises(NotPublishable):
        catalog.abandon(done, "too late")
    assert catalog.abandon(twin, "same") == "published"  # the pointers lead to its source
    assert catalog.publish(twin).count() == 1 and catalog.version() == 1


def test_two_writers_race(catalog):
    for _ in range(4):
        stagings = [staged(catalog, (f"s{i}", f"s{i}.{catalog.version()}"), (f"a{i}", f"a{i}.{catalog.version()}", 1, "active")) for i in range(3)]
        before, outcomes, start = catalog.version(), [], threading.Barrier(3)

        def write(staging, start=start, outcomes=outcomes):
            start.wait()
            try:
                catalog.publish(staging)
                outcomes.append("published")
            except Conflict:
                outcomes.append("conflict")

        threads = [threading.Thread(target=write, args=(s,)) for s in stagings]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert sorted(outcomes) == ["conflict", "conflict", "published"] and catalog.version() == before + 1
        assert catalog.abandon(next(s for s in stagings if catalog.state(s) == "late"), "late") == "abandoned"
    assert catalog.orphans() == []


def test_summaries_change_nothing(catalog):
    for i in range(5):
        catalog.publish(staged(catalog, (f"s{i % 2}", f"s.{i}"), (f"a{i % 3}", f"a.{i}", i, "active")))
    want = {v: led(catalog, v) for v in range(6)}
    stored = catalog.revisions().count()
    catalog.summarize(3)
    assert {v: led(catalog, v) for v in range(6)} == want and catalog.revisions().count() == stored
    summary, entries = catalog.log.since_summary(5)
    assert summary and len(entries) == 2


def test_a_number_is_taken_once(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    assert log.last() == 0 and log.append(1, {"a": 1}) and not log.append(1, {"a": 2})
    assert log.entry(1) == {"a": 1} and log.entry(2) is None and log.last() == 1
    assert create_once(spark, f"{tmp_path}/x/y", "é") and not create_once(spark, f"{tmp_path}/x/y", "z") and read_text(spark, f"{tmp_path}/x/y") == "é"
    wins = []
    threads = [threading.Thread(target=lambda i=i: wins.append(i) if log.append(2, {"by": i}) else None) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and log.entry(2) == {"by": wins[0]}


def test_one_run_at_a_time(spark, tmp_path):
    path = f"{tmp_path}/run.lock"
    with Lock(spark, path, "first"):
        with pytest.raises(LockHeld, match="first"), Lock(spark, path, "second", 0.3):
            pass
    with Lock(spark, path, "third"):
        assert "third" in read_text(spark, path)
    assert read_text(spark, path) is None


def test_plain_publish_moves_active_rows_only(spark):
    from corvia.operators import catalog as C

    source = spark.createDataFrame([("s", "s.1", "w", 1)], SOURCE)
    artifacts = spark.createDataFrame([("a", "a.1", "w", 1, "active"), ("a", "a.2", "w", 2, "active"), ("b", "b.1", "w", 1, "pending_review")], ARTIFACT)
    rows = C.stage("op", source, artifacts, 0)
    empty = spark.createDataFrame([], "kind string, id string, revision_id string")
    assert {(r["id"], r["revision_id"]) for r in C.publish(rows, empty, 0)[0].collect()} == {("s", "s.1"), ("a", "a.2")}
    with pytest.raises(Conflict):
        C.publish(rows.withColumn("state", F.lit("abandoned")), empty, 0)
