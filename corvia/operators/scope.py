"""Mandatory scopes as predicates, and what they drop from a result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """wiki, namespace and version are equal and case-sensitive, never normalized."""

    wiki_id: str
    namespace: str
    version: str
    language: str | None = None
    collections: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.namespace.strip() or not self.version.strip():
            raise ValueError("a scope needs a namespace and a version")


def equal(**values: str | None) -> Column:
    """Equality with every value that is not blank."""
    found = F.lit(True)
    for name, value in values.items():
        if value:
            found = found & (F.col(name) == value)
    return found


def document_filter(namespace: str | None = None, version: str | None = None, language: str | None = None, include_deprecated: bool = False) -> Column:
    """The scope of a document query; deprecated rows only if asked for."""
    found = equal(namespace=namespace, version=version, language=language)
    return found if include_deprecated else found & ~F.coalesce(F.col("deprecated"), F.lit(False))


def knowledge_filter(scope: Scope, also: Column | None = None) -> Column:
    found = equal(wiki_id=scope.wiki_id, namespace=scope.namespace, version=scope.version)
    return found if also is None else found & also


def in_scope(item: Column, scope: Scope, include_stale: bool = False) -> Column:
    """Whether an item (a struct) may be shown: language counts for sources only."""
    ok = (item["wiki_id"] == scope.wiki_id) & (item["namespace"] == scope.namespace) & (item["version"] == scope.version)
    if scope.language:
        ok = ok & ((item["kind"] != "source") | (item["language"] == scope.language))
    ok = ok & item["status"].isin("active", *["stale"] * include_stale)
    if scope.collections:
        ok = ok & F.arrays_overlap(item["rag_collection_ids"], F.array(*map(F.lit, scope.collections)))
    return F.coalesce(ok, F.lit(False))


def filter_result(hits: DataFrame, scope: Scope, include_stale: bool = False) -> DataFrame:
    """Hits with an item struct: in scope, provenance and relations of other scopes pruned, none without provenance.

    ``warnings`` says for each row, kept or not, what was dropped; ``kept`` says whether it stays. Filter on it.
    """
    item = F.col("item")
    blank = lambda value, wanted: (F.coalesce(value, F.lit("")) == "") | (value == wanted)
    of_scope = lambda e: (e["wiki_id"] == scope.wiki_id) & blank(e["namespace"], scope.namespace) & blank(e["version"], scope.version)
    asked = F.array(*map(F.lit, scope.collections)) if scope.collections else None
    provenance = F.filter(item["provenance"], lambda e: of_scope(e) & (F.array_contains(asked, e["rag_collection_id"]) if scope.collections else F.lit(True)))
    relations = F.filter(item["relationships"], lambda r: (r["target_wiki_id"] == scope.wiki_id) & (r["target_namespace"] == scope.namespace) & (r["target_version"] == scope.version))
    found = hits.withColumn("_in", in_scope(item, scope, include_stale)).withColumn("_p", provenance).withColumn("_r", relations)
    warn = lambda when, name: F.when(when, F.lit(name))
    warnings = F.array_compact(F.array(
        warn(~F.col("_in"), "OUT_OF_SCOPE_RESULT_DROPPED"),
        warn(F.col("_in") & (F.size("_p") < F.size(item["provenance"])), "OUT_OF_SCOPE_PROVENANCE_DROPPED"),
        warn(F.col("_in") & (F.size("_r") < F.size(item["relationships"])), "OUT_OF_SCOPE_RELATION_DROPPED"),
        warn(F.col("_in") & (F.size("_p") == 0), "KNOWLEDGE_WITHOUT_PROVENANCE_DROPPED"),
    ))
    collections = F.array_sort(F.array_distinct(F.transform("_p", lambda e: e["rag_collection_id"])))
    scoped = item.withField("provenance", F.col("_p")).withField("relationships", F.col("_r")).withField("rag_collection_ids", collections)
    return found.withColumn("warnings", warnings).withColumn("item", scoped).withColumn("kept", F.col("_in") & (F.size("_p") > 0)).drop("_in", "_p", "_r")


def evidence_range_ok(evidence: Column) -> Column:
    """Both ends or neither, and the end after the start."""
    start, end = evidence["char_start"], evidence["char_end"]
    return (start.isNull() & end.isNull()) | (F.coalesce(end > start, F.lit(False)))


def clear_scope(rows: DataFrame, scope: Scope) -> tuple[DataFrame, int]:
    """Rows without those of a scope, and how many went."""
    own = F.coalesce(knowledge_filter(scope), F.lit(False))
    return rows.where(~own), rows.where(own).count()
