"""Synchronization of a document source: what changed, what is missing, which path a document gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.tables import durable

# The gates of a run and after how many runs a missing document is a candidate for the archive.
LARGE_CHANGE = 0.10
MOST_FAILED = 0.25
MISSING_RUNS = 3
WRITTEN = ["added", "updated", "restored", "moved"]
OPERATIONS = ["added", "unchanged", "updated", "restored", "moved", "failed", "missing", "archived_candidate"]


class StateMoved(RuntimeError):
    """Another run has written the next state."""


def decide(parsed: DataFrame, state: DataFrame, files: DataFrame | None = None, overwrite: bool = True, failed: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """One row per document of parsed or state, with its operation.

    parsed: document_id, canonical_uri, content_hash, file_hash (of what would be written). state: the same with the
    last run's values and missing_count. files: document_id, current_hash (of the local file), same_content.
    failed: document_id of those that couldn't be read this time: they keep their state. missing: document_id of those
    that the source says are gone; without it, whatever of the state is neither parsed nor failed. A missing document
    is archived_candidate from the third time on; one that was never there has a count of 1. Documents of the state
    that nothing is said of have no row.
    """
    new = parsed.select("document_id", F.col("canonical_uri").alias("new_uri"), F.col("content_hash").alias("new_hash"), F.col("file_hash").alias("new_file"), F.lit(True).alias("_new"))
    old = state.select("document_id", F.col("canonical_uri").alias("old_uri"), F.col("content_hash").alias("old_hash"), F.col("file_hash").alias("old_file"), "missing_count", F.lit(True).alias("_old"))
    both = new.join(old, "document_id", "full_outer")
    for name, ids in (("_failed", failed), ("_gone", missing)):
        if ids is None:
            both = both.withColumn(name, F.lit(False) if name == "_failed" else F.lit(True))
        else:
            both = both.join(ids.select("document_id").distinct().withColumn(name, F.lit(True)), "document_id", "full_outer").withColumn(name, F.coalesce(name, F.lit(False)))
    both = both.withColumn("_new", F.coalesce("_new", F.lit(False))).where("_new OR _failed OR _gone")
    if files is None:
        both = both.withColumn("current_hash", F.col("old_file")).withColumn("same_content", F.lit(False))
    else:
        both = both.join(files.select("document_id", "current_hash", "same_content"), "document_id", "left")
    here = F.col("current_hash").isNotNull()
    count = F.when(F.col("_new"), 0).when(F.col("_failed"), F.coalesce("missing_count", F.lit(0))).otherwise(F.coalesce("missing_count", F.lit(0)) + 1)
    edited = ~F.col("current_hash").eqNullSafe(F.col("old_file"))
    operation = (
        F.when(~F.col("_new") & F.col("_failed"), "failed")
        .when(~F.col("_new"), F.when(count >= MISSING_RUNS, "archived_candidate").otherwise("missing"))
        .when(F.col("_old").isNull(), F.when(~here, "added").when(F.coalesce("same_content", F.lit(False)), "unchanged").otherwise("updated"))
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "updated")
        .when(~F.col("old_uri").eqNullSafe(F.col("new_uri")), "moved")
        .when(F.col("current_hash").eqNullSafe(F.col("new_file")), "unchanged")
        .when(edited, "restored" if overwrite else "failed")
        .otherwise("unchanged")
    )
    return both.withColumn("operation", operation).withColumn("missing_count", count.cast("int")).drop("_new", "_old", "_failed", "_gone")


def run_stats(decided: DataFrame) -> DataFrame:
    """One row: documents and a count for each operation."""
    return decided.agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.col("operation") == o).alias(o) for o in OPERATIONS])


def gates(stats: DataFrame, block_large: bool = False) -> DataFrame:
    """Ratios of changed and failed documents, and whether the run may be applied."""
    changed = sum((F.col(o) for o in WRITTEN[1:]), F.col(WRITTEN[0]))
    ratio = lambda n: F.coalesce(F.try_divide(n, F.col("documents")), F.lit(0.0))
    found = stats.withColumn("change_ratio", ratio(changed)).withColumn("failure_ratio", ratio(F.col("failed")))
    large = F.col("change_ratio") >= LARGE_CHANGE
    blocked = ((F.col("failed") > 0) & (F.col("failure_ratio") > MOST_FAILED)) | (large & F.lit(block_large))
    return found.withColumn("large_change", large).withColumn("may_apply", ~blocked)


def final_status(failed: Column, succeeded: Column, dry_run: Column) -> Column:
    return F.when(dry_run, "dry_run").when((failed > 0) & (succeeded > 0), "partial").when(failed > 0, "failed").otherwise("succeeded")


def next_state(decided: DataFrame, state: DataFrame) -> DataFrame:
    """The state after a run: failed documents keep their last values, missing ones their count."""
    kept = decided.where("operation = 'failed'").select("document_id")
    fresh = decided.where("operation <> 'failed'").select("document_id", F.coalesce("new_uri", "old_uri").alias("canonical_uri"), F.coalesce("new_hash", "old_hash").alias("content_hash"), F.when(F.col("operation").isin(WRITTEN), F.col("new_file")).otherwise(F.coalesce("current_hash", "old_file", "new_file")).alias("file_hash"), "missing_count")
    return fresh.unionByName(state.join(kept, "document_id", "left_semi").select(*fresh.columns))


def keepers(paths: DataFrame) -> DataFrame:
    """The best path of each canonical_uri: in the state, not generated, deepest, last by name.

    paths: canonical_uri, path, in_state (boolean). A generated name ends in a dash and ten hexadecimal digits.
    """
    generated = F.col("path").rlike(r"-[0-9a-f]{10}(\.[A-Za-z]+)?$")
    score = F.struct(F.col("in_state").cast("int"), (~generated).cast("int"), F.size(F.split("path", "/")), F.col("path"))
    return paths.groupBy("canonical_uri").agg(F.max_by("path", score).alias("keeper"), F.count(F.lit(1)).alias("copies"))


def quarantine(paths: DataFrame) -> DataFrame:
    """Paths that aren't the keeper of their canonical_uri."""
    return paths.join(keepers(paths).select("canonical_uri", F.col("keeper").alias("path")), ["canonical_uri", "path"], "left_anti")


def rebuilt_state(state: DataFrame, paths: DataFrame) -> DataFrame:
    """The state (canonical_uri, relative_path, ...) with each address at its keeper; addresses without a path go."""
    best = keepers(paths).select("canonical_uri", "keeper")
    first = state.groupBy("canonical_uri").agg(F.max_by(F.struct(*[c for c in state.columns if c != "canonical_uri"]), F.col("relative_path")).alias("_r"))
    return first.join(best, "canonical_uri").select("canonical_uri", "_r.*", "keeper").withColumn("relative_path", F.col("keeper")).drop("keeper").select(*state.columns)


def import_report(files: DataFrame) -> DataFrame:
    """One row on a batch of imports (path, status: inserted, duplicate or failed): counts and its status."""
    counts = files.agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "duplicate", "failed")])
    return counts.withColumn("status", final_status(F.col("failed"), F.col("inserted") + F.col("duplicate"), F.lit(False)))


def reconcile(state: DataFrame, refs: DataFrame) -> DataFrame:
    """State rows under the id that their URI has now; of several the one that is at the preferred path, exists, lies
    deepest, has the oldest file, and is last by path.

    refs: canonical_uri, document_id, preferred_path (null if none). state: document_id, canonical_uri, relative_path,
    present (boolean), mtime (null counts as 0).
    """
    known = refs.select("canonical_uri", F.col("document_id").alias("_now"), *([F.col("preferred_path").alias("_path")] if "preferred_path" in refs.columns else [F.lit(None).cast("string").alias("_path")]))
    keyed = state.join(known, "canonical_uri", "left").withColumn("_id", F.coalesce("_now", "document_id"))
    preferred = F.coalesce(F.col("relative_path") == F.col("_path"), F.lit(False)).cast("int")
    score = F.struct(preferred.alias("a"), F.col("present").cast("int").alias("b"), F.size(F.split("relative_path", "/")).alias("c"), (-F.coalesce(F.col("mtime"), F.lit(0))).alias("d"), F.col("relative_path").alias("e"))
    kept = keyed.groupBy("_id").agg(F.max_by(F.struct(*state.columns), score).alias("_r"))
    return kept.select("_r.*", "_id").withColumn("document_id", F.col("_id")).drop("_id")


def bootstrap_refs(files: DataFrame) -> DataFrame:
    """One reference for each URI of local files: that of the deepest hierarchy, then the oldest, the shortest path and
    the first by name.

    files: canonical_uri, document_id, path, hierarchy (array), mtime.
    """
    score = F.struct((-F.size("hierarchy")).alias("a"), F.coalesce(F.col("mtime"), F.lit(0)).alias("b"), F.size(F.split("path", "/")).alias("c"), F.col("path").alias("d"))
    return files.groupBy("canonical_uri").agg(F.min_by(F.struct("document_id", "path", "hierarchy"), score).alias("_r")).select("canonical_uri", "_r.document_id", F.col("_r.path").alias("relative_path_hint"), "_r.hierarchy")


def hierarchy_labels(refs: DataFrame) -> DataFrame:
    """(key, label): for each hierarchy label, whatever its writing, the most frequent, shortest, last variant."""
    from corvia.functions.text import hierarchy_key

    labels = refs.select(F.explode("hierarchy").alias("label")).select(F.trim("label").alias("label")).where("label <> ''")
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("key", hierarchy_key(F.col("label")))
    return counted.groupBy("key").agg(F.max_by("label", F.struct("n", -F.length("label"), "label")).alias("label"))


def initial_refs(roots: DataFrame, known: DataFrame, ids) -> DataFrame:
    """(canonical_uri, document_id, relative_path_hint, hierarchy): known references of the roots (canonical_uri), new
    ones for the others; ids gives a column of document ids from one of URIs."""
    joined = roots.select("canonical_uri").distinct().join(known, "canonical_uri", "left")
    return joined.select("canonical_uri", F.coalesce("document_id", ids(F.col("canonical_uri"))).alias("document_id"), "relative_path_hint", F.coalesce("hierarchy", F.array().cast("array<string>")).alias("hierarchy"))


def best_refs(found: DataFrame) -> DataFrame:
    """Of several references that led to one document the one of its own id, with a path, with the deepest path.

    found: document_id (of the parsed document), ref_id, relative_path_hint, ord (the order of discovery) and more.
    """
    depth = F.when(F.col("relative_path_hint").isNull(), 0).otherwise(F.size(F.split("relative_path_hint", "/")))
    score = F.struct((F.col("ref_id") == F.col("document_id")).cast("int").alias("a"), F.col("relative_path_hint").isNotNull().cast("int").alias("b"), depth.alias("c"), (-F.col("ord")).alias("d"))
    return found.groupBy("document_id").agg(F.max_by(F.struct(*[c for c in found.columns if c != "document_id"]), score).alias("_r")).select("document_id", "_r.*")


def merge_refs(known: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Refs of both sides; fresh values win where they aren't null, metadata maps are joined key by key."""
    columns = [c for c in known.columns if c != key]
    joined = known.alias("a").join(fresh.alias("b"), key, "full_outer")
    empty = F.create_map().cast("map<string,string>")
    merged = lambda c: F.map_concat(F.map_filter(F.coalesce(F.col(f"a.{c}"), empty), lambda k, _: ~F.map_contains_key(F.coalesce(F.col(f"b.{c}"), empty), k)), F.coalesce(F.col(f"b.{c}"), empty))
    return joined.select(key, *[(merged(c) if dict(known.dtypes)[c].startswith("map") else F.coalesce(f"b.{c}", f"a.{c}")).alias(c) for c in columns])


def choose_paths(documents: DataFrame) -> DataFrame:
    """The path of each document: that of its state, else the proposed one; on a collision all but the first get a suffix.

    documents: document_id, state_path, proposed_path.
    """
    from corvia.functions.text import safe_id_fragment

    wanted = documents.withColumn("path", F.coalesce("state_path", "proposed_path"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.col("state_path").isNull(), "document_id"))
    stem, end = F.regexp_replace("path", r"\.[^./]*$", ""), F.regexp_extract("path", r"(\.[^./]*)$", 1)
    return wanted.withColumn("_n", rank).withColumn("path", F.when(F.col("_n") == 1, F.col("path")).otherwise(F.concat(stem, F.lit("-"), safe_id_fragment(F.col("document_id")), end))).drop("_n")


def proposed_path(hierarchy: Column, title: Column) -> Column:
    """The last six hierarchy labels and the title as a path."""
    from corvia.functions.text import safe_path_component  # columns of arrays can't go through a pandas UDF element by element

    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    last = F.slice(hierarchy, F.greatest(F.lit(1), F.size(hierarchy) - 5), F.lit(6))
    return F.concat(F.array_join(F.transform(last, clean), "/"), F.when(F.size(last) > 0, "/").otherwise(""), safe_path_component(title), F.lit(".md"))


def crawl(links: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(uri, depth): what is reached from the roots over links (source, target), breadth first, up to ``most`` pages.

    Each round joins the last round's pages with the links and takes out what is known; it ends when nothing new is
    reached. Each round's pages are written, so that the lineage stays short.
    """
    last = durable(roots.select("uri", F.lit(0).alias("depth")).distinct().orderBy("uri").limit(most))
    seen, total, depth = last, last.count(), 0
    while total < most:
        depth += 1
        fresh = last.join(links, last["uri"] == links["source"]).select(F.col("target").alias("uri")).distinct().join(seen, "uri", "left_anti")
        last = durable(fresh.orderBy("uri").limit(most - total).withColumn("depth", F.lit(depth)))
        n = last.count()
        if not n:
            break
        seen, total = durable(seen.union(last)), total + n
    return seen


# The journal of a run: what is to be written where, and what has been


def journal(decided: DataFrame, run_id: str, target: Column, staging: str, backups: str) -> DataFrame:
    """One open action for each document that is to be written: where it is staged, goes to and is backed up."""
    written = decided.where(F.col("operation").isin(WRITTEN))
    place = lambda root: F.concat(F.lit(f"{root.rstrip('/')}/{run_id}/"), F.col("target_path"))
    rows = written.withColumn("target_path", target)
    backup = F.when(F.col("current_hash").isNotNull(), place(backups))
    return rows.select(F.lit(run_id).alias("run_id"), "document_id", "operation", "target_path", place(staging).alias("staging_path"), backup.alias("backup_path"), F.col("new_uri").alias("canonical_uri"), F.col("new_hash").alias("content_hash"), F.col("new_file").alias("file_hash"), F.lit(False).alias("completed"))


def journal_problems(actions: DataFrame, run_id: str, staging: str, backups: str, files: DataFrame) -> DataFrame:
    """Actions with the reason why they can't be applied (null: they can), and whether there is nothing left to do.

    files: path, hash of what lies at staging, target and backup paths now.
    """
    from corvia.functions.text import safe_relative_path

    at = lambda side: files.select(F.col("path").alias(f"{side}_path"), F.col("hash").alias(f"_{side}"))
    found = actions.join(at("staging"), "staging_path", "left").join(at("target"), "target_path", "left")
    under = lambda column, root: F.col(column).startswith(f"{root.rstrip('/')}/{run_id}/") & ~F.col(column).rlike(r"(^|/)\.\.(/|$)")
    done = F.col("completed") | (F.col("_target") == F.col("file_hash"))
    problem = (
        F.when(~under("staging_path", staging), "staging path is not the run's").when(~safe_relative_path(F.col("target_path")), "target path is not in the workspace")
        .when(F.coalesce(done, F.lit(False)), None).when(F.col("_staging").isNull(), "staged file is missing")
        .when(F.col("_target").isNotNull() & F.col("backup_path").isNull(), "target has no backup path").when(F.col("_target").isNotNull() & ~under("backup_path", backups), "backup path is not the run's")
    )
    return found.withColumn("problem", problem).withColumn("settled", F.coalesce(done, F.lit(False))).drop("_staging", "_target")


def resume(actions: DataFrame, state: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The journal, the state and the manifest's documents after what was open has been tried again.

    judged: document_id, problem (``journal_problems``). Completed actions stand; open ones without a problem are
    completed; the state takes the entries of all completed actions, and keeps the rest of its rows.
    """
    tried = actions.join(judged.select("document_id", "problem"), "document_id", "left")
    after = tried.withColumn("completed", F.col("completed") | F.col("problem").isNull())
    entries = after.where("completed").select("document_id", "canonical_uri", "content_hash", "file_hash", F.lit(0).alias("missing_count"))
    kept = state.join(entries.select("document_id"), "document_id", "left_anti")
    documents = tried.where("NOT completed").select("document_id", "target_path", F.when(F.col("problem").isNull(), F.col("operation")).otherwise("failed").alias("operation"), "content_hash", "file_hash", F.col("problem").alias("reason"))
    return after.drop("problem"), kept.unionByName(entries, allowMissingColumns=True), documents


def manifest(documents: DataFrame, run_id: str, mode: str) -> DataFrame:
    """One row on a run: its counts, status and what was written."""
    stats = run_stats(documents)
    row = stats.withColumn("run_id", F.lit(run_id)).withColumn("mode", F.lit(mode))
    ok = F.col("documents") - F.col("failed")
    row = row.withColumn("written", sum((F.col(o) for o in WRITTEN[1:]), F.col(WRITTEN[0])))
    return row.withColumn("status", final_status(F.col("failed"), ok, F.lit(mode == "dry_run")))


def retention(entries: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Entries (path, modified) that are older than so many days."""
    return entries.where(F.col("modified") < (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days)))


def retry_delay(attempt: Column, first: float = 1.0, most: float = 60.0, retry_after: Column | None = None, now: Column | None = None, jitter: Column | None = None) -> Column:
    """Seconds to wait: what the server says (seconds, or a date), else doubled from attempt to attempt and lengthened by
    up to a quarter (jitter, from 0 to 1); between 0 and ``most``."""
    doubled = F.lit(first) * F.pow(F.lit(2.0), attempt - 1)
    if jitter is not None:
        doubled = doubled * (1 + jitter / 4)
    if retry_after is None:
        return F.least(F.lit(most), doubled)
    date = F.try_to_timestamp(F.regexp_replace(retry_after, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_timestamp(date) - F.unix_timestamp(now if now is not None else F.current_timestamp())
    said = F.coalesce(retry_after.try_cast("double"), F.when(until < 0, 0).otherwise(until).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(said, doubled)))
