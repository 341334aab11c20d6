import hashlib

import pytest

from corvia import schemas
from corvia.operators import validation as V

TEXT = "The call adds two values. It returns their sum."
HASH = hashlib.sha256(TEXT.encode()).hexdigest()
FINE = {f.name: None for f in schemas.EVIDENCE} | {"document_id": "d", "rag_collection_id": "c", "namespace": "n", "version": "v", "part_id": "p", "content_hash": HASH, "char_start": 0, "char_end": 25, "quote_hint": "adds two"}
DRAFTS = schemas.T.StructType([schemas.field("draft_id", schemas.S), schemas.field("document_id", schemas.S), schemas.field("draft", schemas.DRAFT)])


def draft(claim=None, relation=None, target=None, **more):
    base = {f.name: None for f in schemas.DRAFT} | {"artifact_type": "concept", "wiki_id": "w", "namespace": "n", "version": "v", "canonical_name": "Add", "aliases": [], "open_questions": []}
    related = {"relation_type": "uses", "target_wiki_id": "w", "target_namespace": "n", "target_version": "v", "target_canonical_name": "Sub", "strength_score": None, "evidence": [FINE | (relation or {})]} | (target or {})
    return base | {"claims": [{"text": "t", "confidence": "high", "evidence": [FINE | (claim or {})]}], "related_artifacts": [related]} | more


def document(**more):
    return {f.name: None for f in schemas.SOURCE_DOCUMENT} | {"document_id": "d", "wiki_id": "w", "rag_collection_id": "c", "namespace": "n", "version": "v", "parts": [{"part_id": "p", "parent_part_id": None, "order": 1, "heading_path": [], "content": TEXT}]} | more


CASES = [
    (draft(), []), (draft(claim={"namespace": "", "version": None, "char_start": None, "char_end": None}, relation={"namespace": None}), []), (draft(claims=[], related_artifacts=[]), []),
    (draft(wiki_id="x"), ["ARTIFACT_SCOPE_MISMATCH"]), (draft(namespace="x"), ["ARTIFACT_SCOPE_MISMATCH"]),
    (draft(claim={"namespace": "x"}), ["EVIDENCE_NAMESPACE_MISMATCH"]), (draft(claim={"version": "x"}), ["EVIDENCE_VERSION_MISMATCH"]),
    (draft(claim={"document_id": "x", "part_id": "y", "content_hash": "z"}), ["EVIDENCE_DOCUMENT_MISMATCH"]), (draft(claim={"rag_collection_id": "x"}), ["EVIDENCE_DOCUMENT_MISMATCH"]),
    (draft(claim={"part_id": "x", "content_hash": "y"}), ["EVIDENCE_PART_NOT_FOUND"]), (draft(claim={"content_hash": "x"}), ["EVIDENCE_CONTENT_HASH_MISMATCH"]),
    (draft(claim={"quote_hint": "adds three", "char_start": None}), ["EVIDENCE_QUOTE_NOT_FOUND"]), (draft(claim={"char_end": 400}), ["EVIDENCE_RANGE_OUT_OF_BOUNDS"]), (draft(claim={"char_start": 12}), ["EVIDENCE_RANGE_QUOTE_MISMATCH"]),
    (draft(target={"target_version": "x"}), ["RELATION_SCOPE_MISMATCH"]), (draft(relation={"namespace": "x"}), ["RELATION_EVIDENCE_NAMESPACE_MISMATCH"]), (draft(relation={"version": "x"}), ["RELATION_EVIDENCE_VERSION_MISMATCH"]),
    (draft(relation={"part_id": "x"}), ["RELATION_EVIDENCE_NOT_FOUND"]), (draft(relation={"document_id": "x"}), ["RELATION_EVIDENCE_NOT_FOUND"]), (draft(relation={"content_hash": "x"}), ["RELATION_EVIDENCE_INVALID"]),
    (draft(relation={"quote_hint": "no", "char_end": None}), ["RELATION_EVIDENCE_INVALID"]), (draft(relation={"char_start": 12}), ["RELATION_EVIDENCE_RANGE_QUOTE_MISMATCH"]),
]


def test_every_code(spark):
    drafts = spark.createDataFrame([(str(i), "d", d) for i, (d, _) in enumerate(CASES)] + [("lost", "elsewhere", draft(wiki_id="x"))], DRAFTS)
    found: dict = {}
    for r in V.extraction_issues(drafts, spark.createDataFrame([document()], schemas.SOURCE_DOCUMENT)).collect():
        found.setdefault(r["draft_id"], []).append(r["issue"])
    assert {str(i): sorted(found.get(str(i), [])) for i in range(len(CASES))} == {str(i): sorted(want) for i, (_, want) in enumerate(CASES)}
    assert {code for _, want in CASES for code in want} == set(V.CODES) and "lost" not in found


@pytest.mark.parametrize(("change", "codes"), [
    ({}, []), ({"status": "active"}, ["REVIEW_ARTIFACT_NOT_PENDING"]), ({"source_revision_id": "none"}, ["REVIEW_SOURCE_NOT_FOUND"]), ({"wiki_id": "x"}, ["REVIEW_WIKI_MISMATCH"]),
    ({"draft": draft(version="x")}, ["ARTIFACT_SCOPE_MISMATCH", "REVIEW_SCOPE_MISMATCH"]), ({"bound_revision_id": "sr2"}, ["REVIEW_SOURCE_REVISION_MISMATCH"]), ({"source_ids": ["t"]}, ["REVIEW_SOURCE_ID_MISMATCH"]), ({"source_ids": None}, ["REVIEW_SOURCE_ID_MISMATCH"]),
    ({"draft": draft(claim={"quote_hint": "no", "char_end": None})}, ["EVIDENCE_QUOTE_NOT_FOUND"]),
])
def test_reviews(spark, change, codes):
    T = schemas.T
    artifact = T.StructType([schemas.field(n, schemas.S) for n in ("artifact_revision_id", "source_revision_id", "status", "wiki_id", "bound_revision_id")] + [schemas.field("draft", schemas.DRAFT), schemas.field("source_ids", schemas.STRINGS)])
    source = T.StructType([schemas.field(n, schemas.S) for n in ("source_revision_id", "source_id", "wiki_id")] + [schemas.field("document", schemas.SOURCE_DOCUMENT)])
    row = {"artifact_revision_id": "ar", "source_revision_id": "sr", "status": "pending_review", "wiki_id": "w", "bound_revision_id": change.get("source_revision_id", "sr"), "draft": draft(), "source_ids": ["s"]} | change
    found = V.review_issues(spark.createDataFrame([row], artifact), spark.createDataFrame([{"source_revision_id": "sr", "source_id": "s", "wiki_id": "w", "document": document()}], source))
    assert sorted(r["issue"] for r in found.collect()) == codes
