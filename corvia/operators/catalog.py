"""The knowledge catalog: immutable revisions, pointers to the active ones, staging, merging, validation, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import UNIT, artifact_id, sha256, strip
from corvia.operators.state import NotFound

LEVELS = ["low", "medium", "high"]


def active(pointers: DataFrame, revisions: DataFrame, strict: bool = False) -> DataFrame:
    """Revisions that active pointers (artifact_id, artifact_revision_id) lead to; a dangling one is an error if strict."""
    live = pointers.select("artifact_id", "artifact_revision_id")
    if strict and (lost := live.join(revisions, "artifact_revision_id", "left_anti").select("artifact_id").limit(5).collect()):
        raise NotFound(f"no revision for {[r[0] for r in lost]}")
    return revisions.join(live, ["artifact_id", "artifact_revision_id"], "left_semi")


def _field(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def stage(operation_id: str, source: DataFrame, artifacts: DataFrame, catalog_revision: int) -> DataFrame:
    """Staged rows, invisible to readers, with the catalog's revision that they were made against.

    Rows without a status count as active, without a revision number as the first.
    """

    def rows(kind: str, df: DataFrame, own: str, revision: str) -> DataFrame:
        number, status = _field(df, "revision_number", F.lit(1)).cast("int"), _field(df, "status", F.lit("active"))
        wiki = F.col("wiki_id") if "wiki_id" in df.columns else F.lit(None).cast("string")
        return df.select(F.lit(kind).alias("kind"), F.col(own).alias("id"), F.col(revision).alias("revision_id"), number.alias("revision_number"), status.alias("status"), wiki.alias("wiki_id"), F.to_json(F.struct(*df.columns)).alias("payload"))

    both = rows("source", source, "source_id", "source_revision_id").union(rows("artifact", artifacts, "artifact_id", "artifact_revision_id"))
    return both.withColumn("operation_id", F.lit(operation_id)).withColumn("catalog_revision", F.lit(catalog_revision)).withColumn("state", F.lit("staged"))


class Conflict(RuntimeError):
    """The catalog has moved on since the rows were staged."""


def moves(staged: DataFrame) -> DataFrame:
    """(kind, id, revision_id, revision_number, status): where staged rows move pointers to.

    Sources move, and artifacts that are active (others wait for review); of several revisions of an id the highest.
    """
    live = staged.where("kind = 'source' OR status = 'active'")
    best = live.groupBy("kind", "id").agg(F.max(F.struct("revision_number", "revision_id", "status")).alias("_r"))
    return best.select("kind", "id", "_r.revision_id", "_r.revision_number", "_r.status")


def publish(staged: DataFrame, pointers: DataFrame, catalog_revision: int) -> tuple[DataFrame, int]:
    """Pointers (kind, id, revision_id) after the staged rows, and the catalog's next revision.

    Publishing what the pointers hold already changes nothing; rows staged against another revision, or abandoned ones,
    are a conflict. ``publication.Catalog`` commits such a step for several writers.
    """
    if not staged.where("state = 'abandoned'").isEmpty():
        raise Conflict("abandoned rows can't be published")
    moved = moves(staged).select("kind", "id", "revision_id")
    if moved.join(pointers.select("kind", "id", "revision_id"), ["kind", "id", "revision_id"], "left_anti").isEmpty():
        return pointers, catalog_revision
    if not staged.where(F.col("catalog_revision") != catalog_revision).isEmpty():
        raise Conflict(f"the catalog is at revision {catalog_revision}")
    return pointers.join(moved, ["kind", "id"], "left_anti").unionByName(moved), catalog_revision + 1


def abandon(staged: DataFrame, pointers: DataFrame, reason: str) -> DataFrame:
    """Staged rows as abandoned, or as published where a pointer has moved to them."""
    there = pointers.select("kind", "id", "revision_id").withColumn("_p", F.lit(True))
    return staged.join(there, ["kind", "id", "revision_id"], "left").withColumn("state", F.when(F.col("_p"), "published").otherwise("abandoned")).withColumn("reason", F.when(F.col("state") == "abandoned", F.lit(reason))).drop("_p")


def insert_revisions(stored: DataFrame, fresh: DataFrame, key: str = "artifact_revision_id") -> DataFrame:
    """Revisions are never changed: only new ones are added."""
    return stored.unionByName(fresh.join(stored.select(key), key, "left_anti").dropDuplicates([key]))


# Items


def confidence(claims: Column) -> Column:
    """The lowest confidence of the claims, low if there is none."""
    level = F.array_min(F.transform(claims, lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c["confidence"])))
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), (level - 1).cast("int")), F.lit("low"))


def unique_by(values: Column, *keys: str, last: bool = False) -> Column:
    """Structs with distinct keys, the first of each (or the last, in its place)."""
    key = lambda v: F.struct(*[v[k] for k in keys])
    seen = F.transform(values, key)
    if last:
        kept = F.filter(values, lambda v, i: F.array_position(F.slice(seen, i + 2, F.size(seen)), key(v)) == 0)
    else:
        kept = F.filter(values, lambda v, i: F.array_position(seen, key(v)) == i + 1)
    return kept


def knowledge_item(artifact: Column) -> Column:
    """An artifact as a query item: evidence of all claims once each, claims as lines, the lowest confidence."""
    draft = artifact["draft"]
    evidence = unique_by(F.flatten(F.transform(draft["claims"], lambda c: c["evidence"])), "rag_collection_id", "document_id", "part_id", last=True)
    return F.struct(
        artifact["artifact_id"].alias("id"), draft["artifact_type"].alias("kind"), draft["wiki_id"].alias("wiki_id"), draft["namespace"].alias("namespace"), draft["version"].alias("version"),
        draft["canonical_name"].alias("title"), draft["aliases"].alias("aliases"), draft["summary"].alias("summary"),
        F.array_join(F.transform(draft["claims"], lambda c: c["text"]), "\n").alias("content"), confidence(draft["claims"]).alias("confidence"), artifact["status"].alias("status"),
        F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["rag_collection_id"]))).alias("rag_collection_ids"), evidence.alias("provenance"),
    )


def index_text(draft: Column) -> Column:
    """What of an artifact is indexed: name, aliases, title, summary and claims, one a line."""
    parts = F.concat(F.array(draft["canonical_name"]), draft["aliases"], F.array(draft["title"], draft["summary"]), F.transform(draft["claims"], lambda c: c["text"]))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


# Merging


def ordered_union(a: Column, b: Column) -> Column:
    """Values of both without repeats, in order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)))


#: What tells one relation from another; further evidence for a known one adds none.
RELATION_KEY = ("relation_type", "target_wiki_id", "target_namespace", "target_version", "target_canonical_name")


def merge_drafts(stored: Column, incoming: Column) -> Column:
    """The incoming draft's scalars; aliases, questions, claims and relations of both, the stored ones first.

    Relations are told apart by type and target, claims as a whole. What is stored is kept as it is.
    """
    empty = lambda f: F.coalesce(incoming[f], F.filter(stored[f], lambda _: F.lit(False)))
    both = F.array_distinct(F.concat(F.coalesce(stored["claims"], empty("claims")), empty("claims")))
    key = lambda r: F.struct(*[r[k] for k in RELATION_KEY])
    old, new = F.coalesce(stored["related_artifacts"], empty("related_artifacts")), unique_by(empty("related_artifacts"), *RELATION_KEY)
    known = F.transform(old, key)
    relations = F.concat(old, F.filter(new, lambda r: F.array_position(known, key(r)) == 0))
    merged = incoming.withField("aliases", ordered_union(stored["aliases"], incoming["aliases"])).withField("open_questions", ordered_union(stored["open_questions"], incoming["open_questions"]))
    return merged.withField("claims", both).withField("related_artifacts", relations)


def plan_merges(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """Incoming drafts (draft, source_id) with action created, updated or needs_review, status, artifact_id,
    revision_number, the draft to be stored and the sources.

    The first that holds: review is recommended; several artifacts have the identity; none has; the draft is to be
    kept apart or names another target, which takes the next revision and waits for review. Else the artifact of the
    same identity is updated, its draft merged and its sources joined. catalog: artifact_id, revision_number, and draft
    and source_ids if there are any.
    """
    d = F.col("draft")
    own = artifact_id(d["wiki_id"], d["namespace"], d["version"], d["artifact_type"], d["canonical_name"])
    more = [c for c in ("draft", "source_ids") if c in catalog.columns]
    last = [F.max_by(c, "revision_number").alias(f"_{c}") for c in more]
    matches = catalog.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("_n"), F.max("revision_number").alias("_rev"), *last)
    joined = incoming.withColumn("artifact_id", own).join(matches, "artifact_id", "left")
    wish = d["merge_recommendation"]
    other = wish["target_artifact_id"].isNotNull() & (wish["target_artifact_id"] != F.col("artifact_id"))
    apart = (wish["action"] == "keep_separate") | F.coalesce(other, F.lit(False))
    review = (wish["action"] == "needs_review") | (F.col("_n") > 1)
    action = F.when(review, "needs_review").when(F.col("_n").isNull(), "created").when(apart, "needs_review").otherwise("updated")
    number = F.when(F.coalesce(review, F.lit(False)) | F.col("_n").isNull(), 1).otherwise(F.col("_rev") + 1)
    found = joined.withColumn("action", action).withColumn("status", F.when(action == "needs_review", "pending_review").otherwise("active")).withColumn("revision_number", number)
    if "source_id" in incoming.columns:
        known = F.when(F.col("action") == "updated", F.col("_source_ids")) if "source_ids" in more else F.lit(None).cast("array<string>")
        found = found.withColumn("source_ids", ordered_union(known, F.array("source_id")))
    if "draft" in more:
        found = found.withColumn("draft", F.when(F.col("action") == "updated", merge_drafts(F.col("_draft"), F.col("draft"))).otherwise(F.col("draft")))
    return found.drop("_n", "_rev", *[f"_{c}" for c in more])


def compiler_fingerprint(extractor: Column, prompt: Column, model: Column, schema: Column) -> Column:
    """Whether knowledge was derived by the same protocol."""
    return sha256(F.concat_ws(UNIT, extractor, prompt, model, schema))


def extraction_metadata_issues(extractions: DataFrame, extractor: str, prompt: str, model: str) -> DataFrame:
    """(document_id, issue) of extractions (extractor_version, prompt_version, model) that aren't what was asked for."""
    checks = [("extractor_version", extractor, "EXTRACTOR_VERSION_MISMATCH"), ("prompt_version", prompt, "PROMPT_VERSION_MISMATCH"), ("model", model, "MODEL_MISMATCH")]
    return extractions.select("document_id", F.explode(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lit(v)), issue) for c, v, issue in checks]))).alias("issue"))


# Validation and review


def part_topology_issues(documents: DataFrame) -> DataFrame:
    """(document_id, issue): repeated part ids, order that doesn't rise, unknown parents, and cycles."""
    parts = F.col("parts")
    ids, orders = F.transform(parts, lambda p: p["part_id"]), F.transform(parts, lambda p: p["order"])
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (F.size(parts) < 2) | (F.get(orders, i) > F.get(orders, i - 1)))
    unknown = F.exists(parts, lambda p: p["parent_part_id"].isNotNull() & ~F.array_contains(ids, p["parent_part_id"]))
    parent_of = F.map_from_entries(F.transform(unique_by(parts, "part_id"), lambda p: F.struct(p["part_id"], p["parent_part_id"])))
    climbed = F.transform(ids, lambda i: F.aggregate(parts, i, lambda at, _: F.when(at.isNotNull(), F.try_element_at(parent_of, at))))
    cycle = F.exists(climbed, lambda at: at.isNotNull())  # as many steps up as there are parts lead out, or round
    issues = F.array_compact(F.array(F.when(F.size(F.array_distinct(ids)) < F.size(ids), "DUPLICATE_PART_ID"), F.when(~rising, "PART_ORDER_NOT_INCREASING"), F.when(unknown, "UNKNOWN_PARENT_PART"), F.when(cycle, "PART_CYCLE")))
    return documents.select("document_id", F.explode(issues).alias("issue"))


def evidence_issues(drafts: DataFrame, documents: DataFrame) -> DataFrame:
    """(draft_id, issue): claims without text or evidence, and evidence whose document, part, hash, scope or range is wrong.

    drafts: draft_id, document_id, draft. Empty scopes of evidence are the document's own.
    """
    claims = drafts.select("draft_id", F.col("document_id").alias("own_document"), F.col("draft.namespace").alias("ns"), F.col("draft.version").alias("v"), F.explode("draft.claims").alias("c"))
    empty = claims.select("draft_id", F.explode(F.array_compact(F.array(F.when(strip(F.coalesce(F.col("c.text"), F.lit(""))) == "", "CLAIM_WITHOUT_TEXT"), F.when(F.size("c.evidence") < 1, "CLAIM_WITHOUT_EVIDENCE")))).alias("issue"))
    held = documents.select(F.col("document_id").alias("d_id"), F.col("content_hash").alias("d_hash"), F.transform("parts", lambda p: F.struct(p["part_id"].alias("id"), F.length(p["content"]).alias("n"))).alias("d_parts"))
    each = claims.select("draft_id", "own_document", "ns", "v", F.explode("c.evidence").alias("e")).join(held, F.col("e.document_id") == F.col("d_id"), "left")
    part = F.get(F.filter("d_parts", lambda p: p["id"] == F.col("e.part_id")), F.lit(0))
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    start, end = F.col("e.char_start"), F.col("e.char_end")
    found = F.array_compact(F.array(
        F.when(F.col("e.document_id") != F.col("own_document"), "EVIDENCE_OF_OTHER_DOCUMENT"),
        F.when(F.col("d_id").isNull(), "UNKNOWN_DOCUMENT"),
        F.when(F.col("d_id").isNotNull() & ~blank(F.col("e.part_id")) & part.isNull(), "UNKNOWN_PART"),
        F.when(~blank(F.col("e.content_hash")) & (F.col("e.content_hash") != F.col("d_hash")), "CONTENT_HASH_MISMATCH"),
        F.when(~blank(F.col("e.namespace")) & (F.col("e.namespace") != F.col("ns")), "NAMESPACE_MISMATCH"),
        F.when(~blank(F.col("e.version")) & (F.col("e.version") != F.col("v")), "VERSION_MISMATCH"),
        F.when(start.isNull() != end.isNull(), "HALF_OPEN_RANGE"),
        F.when(end <= start, "EMPTY_RANGE"),
        F.when(part.isNotNull() & (end > part["n"]), "RANGE_BEYOND_PART"),
    ))
    return empty.union(each.select("draft_id", F.explode(found)))


def validation_summary(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """(draft_id, passed, issues) for every draft."""
    return drafts.select("draft_id").join(issues.groupBy("draft_id").agg(F.array_sort(F.collect_list("issue")).alias("issues")), "draft_id", "left").select("draft_id", F.col("issues").isNull().alias("passed"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"))


def provenance_coverage(summary: DataFrame) -> DataFrame:
    """1.0 if every draft passed (or there is none), else 0.0."""
    return summary.agg(F.coalesce(F.every("passed"), F.lit(True)).cast("double").alias("coverage"))


def pending_reviews(revisions: DataFrame) -> DataFrame:
    return revisions.where("status = 'pending_review'")


def decide_reviews(revisions: DataFrame, decisions: DataFrame, issues: DataFrame) -> DataFrame:
    """Revisions after decisions (artifact_revision_id, approve): only pending ones move; an approval needs no issues (draft_id)."""
    bad = issues.select(F.col("draft_id").alias("artifact_revision_id")).distinct().withColumn("_bad", F.lit(True))
    joined = revisions.join(decisions.select("artifact_revision_id", "approve"), "artifact_revision_id", "left").join(bad, "artifact_revision_id", "left")
    pending = F.col("status") == "pending_review"
    status = F.when(pending & F.col("approve") & F.col("_bad").isNull(), "active").when(pending & ~F.col("approve"), "archived").otherwise(F.col("status"))
    outcome = F.when(F.col("approve").isNull(), "kept").when(~pending, "conflict").when(F.col("approve") & F.col("_bad").isNotNull(), "rejected_by_validation").otherwise("decided")
    return joined.withColumn("outcome", outcome).withColumn("status", status).drop("approve", "_bad")


def updates_due(sources: DataFrame, state: DataFrame) -> DataFrame:
    """Sources with outcome created, updated or unchanged: unchanged if content hash and compiler fingerprint are the same."""
    old = state.select("source_id", F.col("content_hash").alias("_h"), F.col("fingerprint").alias("_f"))
    joined = sources.join(old, "source_id", "left")
    return joined.withColumn("outcome", F.when(F.col("_h").isNull(), "created").when((F.col("_h") == F.col("content_hash")) & (F.col("_f") == F.col("fingerprint")), "unchanged").otherwise("updated")).drop("_h", "_f")


def cache_misses(source_hits: DataFrame, wiki_items: DataFrame) -> DataFrame:
    """(rag_collection_id, document_id) of source hits that no wiki item has as provenance."""
    held = wiki_items.select(F.explode("provenance").alias("p")).select("p.rag_collection_id", "p.document_id").distinct()
    return source_hits.select("rag_collection_id", "document_id").distinct().join(held, ["rag_collection_id", "document_id"], "left_anti")
