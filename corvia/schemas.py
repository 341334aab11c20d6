"""Table schemas. They are fixed: readers apply them and never infer types."""

from __future__ import annotations

from pyspark.sql import types as T


def field(name: str, kind: T.DataType, nullable: bool = True, **meta) -> T.StructField:
    return T.StructField(name, kind, nullable, meta)


S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STRINGS = T.ArrayType(S)

#: One API document of a vector collection; metadata says what is indexed and how vectors are compared.
API_DOCUMENT = T.StructType([
    field("id", S, False), field("namespace", S, indexed=True), field("api_id", S, indexed=True), field("name", S, indexed=True),
    field("api_name", S), field("version", S, indexed=True), field("kind", S), field("language", S, indexed=True),
    field("version_support", STRINGS), field("deprecated", B, indexed=True), field("ingested_at", L), field("description", S),
    field("signature", S), field("parameters_md", S), field("returns_json", S), field("examples", STRINGS),
    field("source_markdown", S), field("deprecation_note", S),
    field("dense_embedding", T.ArrayType(T.FloatType()), metric="cosine"),
    field("sparse_embedding", T.MapType(I, D), metric="inner_product"),
])

#: Where a statement of an artifact comes from.
EVIDENCE = T.StructType([
    field("document_id", S), field("rag_collection_id", S), field("namespace", S), field("version", S), field("part_id", S),
    field("content_hash", S), field("path", S), field("source_url", S), field("char_start", I), field("char_end", I), field("quote_hint", S),
])
CLAIM = T.StructType([field("text", S), field("confidence", S), field("evidence", T.ArrayType(EVIDENCE))])
RELATION = T.StructType([
    field("relation_type", S), field("target_wiki_id", S), field("target_namespace", S), field("target_version", S),
    field("target_canonical_name", S), field("evidence", T.ArrayType(EVIDENCE)), field("strength_score", D),
])
DRAFT = T.StructType([
    field("artifact_type", S), field("wiki_id", S), field("namespace", S), field("version", S), field("canonical_name", S),
    field("title", S), field("aliases", STRINGS), field("summary", S), field("claims", T.ArrayType(CLAIM)),
    field("open_questions", STRINGS), field("related_artifacts", T.ArrayType(RELATION)),
    field("merge_recommendation", T.StructType([field("action", S), field("target_artifact_id", S), field("reason", S)])),
])
ARTIFACT = T.StructType([
    field("artifact_id", S), field("artifact_revision_id", S), field("wiki_id", S), field("revision_number", I),
    field("status", S), field("draft", DRAFT), field("source_ids", STRINGS),
])

PART = T.StructType([field("part_id", S), field("parent_part_id", S), field("order", I), field("heading_path", STRINGS), field("content", S)])
SOURCE_DOCUMENT = T.StructType([
    field("document_id", S), field("wiki_id", S), field("rag_collection_id", S), field("namespace", S), field("version", S),
    field("content_hash", S), field("source_path", S), field("source_url", S), field("parts", T.ArrayType(PART)),
])

EDGE = T.StructType([
    field("edge_id", S), field("wiki_id", S), field("namespace", S), field("version", S), field("source_id", S),
    field("target_id", S), field("relation_type", S), field("strength_score", D), field("strength_tier", S),
    field("direction", S), field("density_count", L), field("reverse_edge_id", S),
])

SYNC_STATE = T.StructType([
    field("source_id", S), field("document_id", S), field("canonical_uri", S), field("relative_path", S), field("content_hash", S),
    field("file_hash", S), field("last_seen_at", T.TimestampType()), field("missing_count", I), field("lifecycle_status", S),
])

#: What every retrieval channel returns; ``ord`` is the order of hits before ranking.
HIT = T.StructType([
    field("query_id", S), field("kind", S), field("id", S), field("channel", S), field("ranking", S), field("raw_score", D), field("ord", L),
])

# The closed sets of the data model.
ENUMS = {
    "confidence": ["low", "medium", "high"],
    "channel": ["exact", "alias", "metadata", "lexical", "dense", "sparse", "graph"],
    "status": ["active", "pending_review", "stale", "archived", "rejected"],
    "operation": ["added", "updated", "moved", "restored", "unchanged", "missing", "archived", "failed"],
}


class SchemaMismatch(ValueError):
    """A table does not have the schema that is asked for."""


def assert_compatible(actual: T.StructType, wanted: T.StructType) -> None:
    """Same fields, types and metadata, in any order."""
    have, want = ({f.name: (f.dataType.simpleString(), f.metadata) for f in s} for s in (actual, wanted))
    if have != want:
        raise SchemaMismatch(f"fields differ: {sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))}")


def migration(stored: T.StructType, wanted: T.StructType) -> tuple[list[str], list[str]]:
    """Columns to add with 0 and orphan columns to keep; other changes are refused.

    Only nullable numbers can be added; strings, booleans, arrays and vectors can't, and no type may change.
    """
    have = {f.name: f for f in stored}
    add = []
    for f in wanted:
        if f.name in have:
            if have[f.name].dataType != f.dataType:
                raise SchemaMismatch(f"{f.name} would change from {have[f.name].dataType.simpleString()} to {f.dataType.simpleString()}")
        elif isinstance(f.dataType, T.NumericType) and f.nullable:
            add.append(f.name)
        else:
            raise SchemaMismatch(f"{f.name} can't be added: only nullable numbers can")
    return add, [n for n in have if n not in {f.name for f in wanted}]
