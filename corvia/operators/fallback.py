"""Unified retrieval beyond the wiki: source hits as items, their fusion with the wiki's, and what the wiki lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.functions.text import sha256
from corvia.operators.retrieval import fuse_hits, top_ranked

# The routes of an answer and the texts that go with them.
WIKI_HIT, RAG_FALLBACK, WIKI_PLUS_RAG = "wiki_hit", "rag_fallback", "wiki_plus_rag"
MISS = "LLM Wiki artifact missing or insufficient for this query"
ENRICH = "RAG fallback returned a source without a valid Wiki artifact"
CHANNELS = ["exact", "alias", "lexical", "dense", "sparse", "metadata", "graph"]
#: Source hits of a request at most.
MOST = 50
#: What a hit of the second list is numbered from, so that it comes after all of the first.
SECOND = 1_000_000


def source_limit(top_k: int) -> int:
    return min(max(2 * top_k, top_k), MOST)


def source_content(fields: dict[str, Column]) -> Column:
    """The source's markdown, else signature, description, parameters, returns and examples, one below the other."""
    parts = F.array(*[fields[f] for f in ("signature", "description", "parameters_md", "returns_json")], F.array_join(F.coalesce(fields["examples"], F.array().cast("array<string>")), "\n"))
    joined = F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")
    return F.coalesce(F.nullif(fields["source_markdown"], F.lit("")), joined)


def source_hits(found: DataFrame, docs: DataFrame, namespace: str, version: str, collection: str, language: str | None = None) -> DataFrame:
    """Hits (query_id, id, score, channel, rank) with what a source says: document_id, title, summary, content, ...

    docs has the columns of an API document. A blank api_id is the row's id, a blank api_name the name, and that the
    document's id.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    document = F.coalesce(F.nullif(text("api_id"), F.lit("")), F.col("id").cast("string"))
    name = F.coalesce(F.nullif(text("api_name"), F.lit("")), F.nullif(text("name"), F.lit("")), document)
    own = F.lit(language) if language else F.nullif(text("language"), F.lit(""))
    fields = {c: F.col(c) for c in ("signature", "description", "parameters_md", "returns_json", "examples", "source_markdown")}
    rows = found.join(docs, "id")
    url = [text(c).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("source_url", "source_path")]
    return rows.select("query_id", document.alias("document_id"), F.lit(collection).alias("rag_collection_id"), F.lit(namespace).alias("namespace"), F.lit(version).alias("version"), name.alias("title"), text("description").alias("summary"), source_content(fields).alias("content"), own.alias("language"), "channel", F.col("score").alias("raw_score"), *url, "rank")


def source_items(hits: DataFrame, wiki_id: str) -> DataFrame:
    """Source hits as items of a wiki: of high confidence, active, with themselves as evidence."""
    evidence = F.struct(F.lit(wiki_id).alias("wiki_id"), "rag_collection_id", "document_id", F.col("source_path").alias("path"), "source_url", "namespace", "version")
    return hits.select(
        "query_id", F.concat(F.lit("source:"), "rag_collection_id", F.lit(":"), "document_id").alias("id"), F.lit("source").alias("kind"), F.lit(wiki_id).alias("wiki_id"),
        F.when(F.col("rag_collection_id") != "", F.array("rag_collection_id")).otherwise(F.array().cast("array<string>")).alias("rag_collection_ids"), "namespace", "version", "title", "summary", "content", "language",
        F.lit("high").alias("confidence"), F.lit("active").alias("status"), F.array(evidence).alias("provenance"), "channel", "raw_score", "rank",
    )


def as_hits(items: DataFrame, group: str, after: int = 0) -> DataFrame:
    """Ranked items as hits of one channel each, in rankings of a group."""
    return items.select("query_id", "kind", "id", "channel", F.concat(F.lit(f"{group}:"), "channel").alias("ranking"), "raw_score", (F.col("rank") + after).cast("long").alias("ord"), "confidence", "status")


def reentered(ranked: DataFrame, after: int = 0) -> DataFrame:
    """Fused items as hits again: under the first of their signals by name, with their score."""
    known = F.filter("rank_signals", lambda s: s.isin(CHANNELS))
    channel = F.coalesce(F.get(known, F.lit(0)), F.lit("dense"))
    return as_hits(ranked.withColumn("channel", channel).withColumn("raw_score", F.col("score")), "wiki", after)


def ranked_sources(items: DataFrame, top_k: int) -> DataFrame:
    """Source items by their own fusion (query_id, kind, id, score, rank_signals, match_confidence, rank, ...)."""
    return with_items(top_ranked(fuse_hits(as_hits(items, "rag")).join(items.select("query_id", "id", "namespace", "version", "title").distinct(), ["query_id", "id"]), source_limit(top_k)), items)


def with_items(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Ranked ids with the fields of their items; the evidence of all items of an id is put together, each once."""
    out = ("query_id", "kind", "id", "channel", "raw_score", "rank", "score", "rank_signals", "match_confidence", "ord")
    fields = [c for c in items.columns if c not in out]
    order = F.col("rank") if "rank" in items.columns else F.lit(0)
    own = items.groupBy("query_id", "kind", "id").agg(F.min_by(F.struct(*fields), order).alias("_i"), *([F.flatten(F.collect_list("provenance")).alias("_p")] if "provenance" in fields else []))
    found = ranked.select("query_id", "kind", "id", "score", "rank_signals", "match_confidence", "rank").join(own, ["query_id", "kind", "id"]).select("*", "_i.*").drop("_i")
    if "provenance" not in fields:
        return found
    return found.withColumn("provenance", F.array_distinct("_p")).drop("_p")


def merged(wiki: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """The wiki's weak items and the sources, both ranked before, fused into one ranking; wiki items come first in ties."""
    hits = reentered(wiki).unionByName(reentered(sources, SECOND))
    items = wiki.unionByName(sources, allowMissingColumns=True)
    titles = items.select("query_id", "id", "namespace", "version", "title").dropDuplicates(["query_id", "id"])
    return with_items(top_ranked(fuse_hits(hits).join(titles, ["query_id", "id"]), limit), items)


def missing_documents(hits: DataFrame, wiki: DataFrame, wiki_id: str) -> DataFrame:
    """(query_id, wiki_id, rag_collection_id, document_id, reason): source hits whose document no item of the wiki cites."""
    cited = wiki.where(F.col("wiki_id") == wiki_id).select("query_id", F.explode("provenance").alias("p")).select("query_id", F.col("p.document_id").alias("document_id")).distinct()
    return hits.join(cited, ["query_id", "document_id"], "left_anti").select("query_id", F.lit(wiki_id).alias("wiki_id"), "rag_collection_id", "document_id", F.lit(MISS).alias("reason"))


def enrichment_requests(hits: DataFrame, misses: DataFrame) -> DataFrame:
    """One request for each missing (collection, document) of a query, with the scope of its first hit."""
    keys = ["query_id", "rag_collection_id", "document_id"]
    first = hits.groupBy(*keys).agg(F.min_by(F.struct("namespace", "version"), "rank").alias("_s"))
    wanted = misses.select(*keys, "wiki_id").distinct()
    return first.join(wanted, keys).select(*keys, "wiki_id", "_s.namespace", "_s.version", F.lit(ENRICH).alias("reason"))


def update_documents(hits: DataFrame, wiki_id: str) -> DataFrame:
    """Source hits as documents for an update of the wiki: each (collection, document) once, with one part."""
    content = F.coalesce(F.nullif("content", F.lit("")), F.nullif("summary", F.lit("")), F.col("title"))
    first = hits.groupBy("rag_collection_id", "document_id").agg(F.min_by(F.struct("namespace", "version", content.alias("content"), "source_path", "source_url"), "rank").alias("_h"))
    part = F.struct(F.concat("document_id", F.lit(":body")).alias("part_id"), F.lit(None).cast("string").alias("parent_part_id"), F.lit(0).alias("order"), F.array().cast("array<string>").alias("heading_path"), F.col("_h.content").alias("content"))
    return first.select("document_id", F.lit(wiki_id).alias("wiki_id"), "rag_collection_id", "_h.namespace", "_h.version", sha256(F.col("_h.content")).alias("content_hash"), F.nullif("_h.source_path", F.lit("")).alias("source_path"), F.nullif("_h.source_url", F.lit("")).alias("source_url"), F.array(part).alias("parts"))


def abstention(best: Column, found: Column) -> Column:
    """struct(recommended, reason, guidance) from the best item's confidence and whether there is one."""
    said = lambda recommended, reason, guidance: F.struct(F.lit(recommended).alias("recommended"), reason.alias("reason"), F.lit(guidance).alias("guidance"))
    none = said(True, F.lit("no matching Wiki or source RAG items"), "Say the knowledge base has no reliable match instead of guessing.")
    weak = said(True, F.lit("best fallback match is weak"), "Treat the matches as hints and verify before asserting facts.")
    good = said(False, F.concat(F.lit("best match confidence: "), best), "Use provenance when presenting factual claims.")
    return F.when(~found, none).when(best == "weak", weak).otherwise(good)


def budget_usage(selected: Column, available: Column, limit: Column) -> Column:
    return F.struct(selected.cast("long").alias("selected"), available.cast("long").alias("available"), limit.cast("long").alias("limit"), (available > limit).alias("truncated"))


def agent_documents(found: DataFrame, include_score: bool) -> DataFrame:
    """Answers of a document query as they are given out; a row without name, namespace or version is an error."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    for c in ("name", "namespace", "version"):
        found = found.withColumn(c, F.when(blank(c), F.raise_error(F.concat(F.lit(f"no {c}: "), F.col("id").cast("string")))).otherwise(F.col(c)))
    kept = ["query_id", "rank", "id", "name", "namespace", "version", *(c for c in ("api_name", "description", "signature", "parameters_md", "returns_json", "examples", "deprecated", "deprecation_note") if c in found.columns)]
    return found.select(*kept, F.col("score") if include_score else F.lit(None).cast("double").alias("score"))
