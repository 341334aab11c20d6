"""What an extraction may say: each statement must be borne out by the document that it was made from.

One row for each piece of evidence, beside its document, is checked by columns; nothing is gathered. Codes are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import sha256

# The codes of what can be wrong with artifacts, evidence of claims, relations, and reviews.
CODES = [
    "ARTIFACT_SCOPE_MISMATCH",
    "EVIDENCE_NAMESPACE_MISMATCH", "EVIDENCE_VERSION_MISMATCH", "EVIDENCE_DOCUMENT_MISMATCH", "EVIDENCE_PART_NOT_FOUND", "EVIDENCE_CONTENT_HASH_MISMATCH", "EVIDENCE_QUOTE_NOT_FOUND", "EVIDENCE_RANGE_OUT_OF_BOUNDS", "EVIDENCE_RANGE_QUOTE_MISMATCH",
    "RELATION_SCOPE_MISMATCH", "RELATION_EVIDENCE_NAMESPACE_MISMATCH", "RELATION_EVIDENCE_VERSION_MISMATCH", "RELATION_EVIDENCE_NOT_FOUND", "RELATION_EVIDENCE_INVALID", "RELATION_EVIDENCE_RANGE_QUOTE_MISMATCH",
]
REVIEW_CODES = ["REVIEW_ARTIFACT_NOT_PENDING", "REVIEW_SOURCE_NOT_FOUND", "REVIEW_WIKI_MISMATCH", "REVIEW_SCOPE_MISMATCH", "REVIEW_SOURCE_REVISION_MISMATCH", "REVIEW_SOURCE_ID_MISMATCH"]


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _codes(**checks: Column) -> Column:
    """The codes of the checks that hold, by name."""
    return F.array_compact(F.array(*[F.when(F.coalesce(check, F.lit(False)), code) for code, check in checks.items()]))


def extraction_issues(drafts: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """(draft_id, issue) for each thing that is wrong with drafts (draft_id, document_id, draft), once for each place.

    documents: document_id, wiki_id, rag_collection_id, namespace, version, parts (part_id, content), and the key that
    drafts name them by, if it is another. Evidence without a
    namespace or version speaks of the document's own. A draft whose document isn't there has no issue here.
    """
    held = documents.select(F.col(key).alias("d_id"), F.struct("document_id", "wiki_id", "rag_collection_id", "namespace", "version").alias("doc"), "parts")
    own = drafts.join(held, drafts["document_id"] == held["d_id"]).select("draft_id", "draft", "doc", "parts")
    d, doc = F.col("draft"), F.col("doc")
    outside = lambda wiki, ns, v: _differ(wiki, doc["wiki_id"]) | _differ(ns, doc["namespace"]) | _differ(v, doc["version"])
    artifacts = own.select("draft_id", F.explode(_codes(ARTIFACT_SCOPE_MISMATCH=outside(d["wiki_id"], d["namespace"], d["version"]))).alias("issue"))
    relations = own.select("draft_id", "doc", "parts", F.explode("draft.related_artifacts").alias("r"))
    r = F.col("r")
    apart = relations.select("draft_id", F.explode(_codes(RELATION_SCOPE_MISMATCH=outside(r["target_wiki_id"], r["target_namespace"], r["target_version"]))).alias("issue"))
    of_claims = own.select("draft_id", "doc", "parts", F.explode("draft.claims").alias("c")).select("draft_id", "doc", "parts", F.explode("c.evidence").alias("e"))
    of_relations = relations.select("draft_id", "doc", "parts", F.explode("r.evidence").alias("e"))

    def checked(rows: DataFrame, codes) -> DataFrame:
        e = F.col("e")
        blank = lambda x: F.coalesce(x, F.lit("")) == ""
        part = F.get(F.filter("parts", lambda p: p["part_id"] == F.col("e.part_id")), F.lit(0))
        seen = rows.select("draft_id", "doc", "e", part.alias("part"))
        text, quote = F.col("part.content"), F.coalesce(e["quote_hint"], F.lit(""))
        ranged = e["char_start"].isNotNull() & e["char_end"].isNotNull()
        facts = {
            "namespace": ~blank(e["namespace"]) & _differ(e["namespace"], doc["namespace"]), "version": ~blank(e["version"]) & _differ(e["version"], doc["version"]),
            "other": _differ(e["document_id"], doc["document_id"]) | _differ(e["rag_collection_id"], doc["rag_collection_id"]), "no_part": F.col("part").isNull(),
            "hash": _differ(e["content_hash"], sha256(text)), "quote": ~F.contains(text, quote), "beyond": e["char_end"] > F.length(text),
            "range": ranged & ~F.contains(F.substring(text, e["char_start"] + 1, F.greatest(e["char_end"] - e["char_start"], F.lit(0))), quote),
        }
        return seen.select("draft_id", F.explode(codes(facts)).alias("issue"))

    def claim_codes(f: dict[str, Column]) -> Column:
        found = ~f["other"] & ~f["no_part"]
        return _codes(
            EVIDENCE_NAMESPACE_MISMATCH=f["namespace"], EVIDENCE_VERSION_MISMATCH=f["version"], EVIDENCE_DOCUMENT_MISMATCH=f["other"], EVIDENCE_PART_NOT_FOUND=~f["other"] & f["no_part"],
            EVIDENCE_CONTENT_HASH_MISMATCH=found & f["hash"], EVIDENCE_QUOTE_NOT_FOUND=found & f["quote"], EVIDENCE_RANGE_OUT_OF_BOUNDS=found & f["beyond"], EVIDENCE_RANGE_QUOTE_MISMATCH=found & f["range"],
        )

    def relation_codes(f: dict[str, Column]) -> Column:
        lost = f["other"] | f["no_part"]
        return _codes(
            RELATION_EVIDENCE_NAMESPACE_MISMATCH=f["namespace"], RELATION_EVIDENCE_VERSION_MISMATCH=f["version"], RELATION_EVIDENCE_NOT_FOUND=lost,
            RELATION_EVIDENCE_INVALID=~lost & (f["hash"] | f["quote"]), RELATION_EVIDENCE_RANGE_QUOTE_MISMATCH=~lost & f["range"],
        )

    return artifacts.union(apart).union(checked(of_claims, claim_codes)).union(checked(of_relations, relation_codes))


def review_issues(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """(artifact_revision_id, issue) of artifacts that are to be reviewed against the source revisions that they were made from.

    artifacts: artifact_revision_id, source_revision_id (the one that the review asks for), status, wiki_id, draft,
    bound_revision_id (the artifact's own), source_ids. sources: source_revision_id, source_id, wiki_id, document (as for
    ``extraction_issues``, a struct). What the draft says is checked against that document too.
    """
    held = sources.select("source_revision_id", F.struct("source_id", "wiki_id", "document").alias("s"))
    both = artifacts.join(held, "source_revision_id", "left")
    s, d = F.col("s"), F.col("draft")
    there = s.isNotNull()
    codes = _codes(
        REVIEW_ARTIFACT_NOT_PENDING=_differ(F.col("status"), F.lit("pending_review")), REVIEW_SOURCE_NOT_FOUND=~there,
        REVIEW_WIKI_MISMATCH=there & (_differ(F.col("wiki_id"), s["wiki_id"]) | _differ(d["wiki_id"], s["document"]["wiki_id"])),
        REVIEW_SCOPE_MISMATCH=there & (_differ(d["namespace"], s["document"]["namespace"]) | _differ(d["version"], s["document"]["version"])),
        REVIEW_SOURCE_REVISION_MISMATCH=there & _differ(F.col("bound_revision_id"), F.col("source_revision_id")), REVIEW_SOURCE_ID_MISMATCH=there & ~F.coalesce(F.array_contains("source_ids", s["source_id"]), F.lit(False)),
    )
    own = both.select("artifact_revision_id", F.explode(codes).alias("issue"))
    drafts = both.where(there).select(F.col("artifact_revision_id").alias("draft_id"), F.col("source_revision_id").alias("document_id"), "draft")
    said = extraction_issues(drafts, sources.select("source_revision_id", "document.*"), "source_revision_id")
    return own.union(said.select(F.col("draft_id").alias("artifact_revision_id"), "issue"))
