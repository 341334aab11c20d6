"""The entry points: knowledge queries, document queries, construction and indexing, reindexing."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from time import perf_counter

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.operators import capsule, catalog, fallback, graph, retrieval, scope, state
from corvia.operators.ranking import top_per
from corvia.schemas import HIT
from corvia.sources import api_documents, ranged
from corvia.sources.log import create_once
from corvia.tables import durable

#: A recall channel: (query, scope, limit) -> hits; and a relation channel: (seeds, scope, limit) -> hits.
Reader = Callable[[str, scope.Scope, int], DataFrame]
SEEDS = 3
#: Artifacts of one name or alias that are taken up; more than any answer holds.
EXACT = 1000


def empty_reader(spark: SparkSession) -> Reader:
    """A channel that finds nothing."""
    return lambda *_: spark.createDataFrame([], HIT)


def artifact_hits(artifacts: DataFrame, query: str, limit: int) -> DataFrame:
    """Hits of the catalog's active artifacts (canonical_name, aliases, title, summary, ...) by name, alias and words.

    An exact name rules out the alias channel; words come on top. Exact and alias hits are ordered by id and cut only
    by the ranking that follows, beyond the ``EXACT`` first.
    """
    wanted = query.lower().strip()
    name = F.lower("canonical_name") == wanted
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == wanted)
    score = retrieval.lexical_score(query, F.col("canonical_name"), F.col("aliases"), F.col("summary"))
    row = lambda channel, raw, order: (F.lit("q").alias("query_id"), F.col("artifact_type").alias("kind"), F.col("artifact_id").alias("id"), F.lit(channel).alias("channel"), F.lit(f"artifact:catalog-{channel}").alias("ranking"), raw.alias("raw_score"), order.alias("ord"), F.col("confidence"), F.col("status"))
    first = lambda df: df.orderBy("artifact_id").limit(EXACT)
    by_id = F.row_number().over(Window.orderBy("artifact_id"))  # of a bounded number of rows
    exact = first(artifacts.where(name)).select(*row("exact", F.lit(None).cast("double"), by_id.cast("long")))
    aliased = first(artifacts.where(alias & ~F.coalesce(name, F.lit(False)))).select(*row("alias", F.lit(None).cast("double"), (F.lit(1_000_000) + by_id).cast("long")))
    lexical = artifacts.withColumn("_s", score).where("_s > 0").orderBy(F.desc("_s"), "artifact_id").limit(limit)
    order = F.lit(2_000_000) + F.row_number().over(Window.orderBy(F.desc("_s"), "artifact_id"))
    return exact.union(aliased).union(lexical.select(*row("lexical", F.col("_s").cast("double"), order.cast("long"))))


@dataclass
class Answer:
    """Ranked items, their capsule, and what there is to say about them.

    trace: (name, status, duration_ms, details) of the five stages. budget: (area, selected, available, limit,
    truncated). sources, misses and requests are there once the sources were asked.
    """

    ranked: DataFrame
    capsule: DataFrame
    warnings: list[str] = field(default_factory=list)
    abstained: bool = False
    reason: str = ""
    route: str = fallback.WIKI_HIT
    trace: list[dict] = field(default_factory=list)
    budget: list[dict] = field(default_factory=list)
    sources: DataFrame | None = None
    misses: DataFrame | None = None
    requests: DataFrame | None = None

    def trace_table(self) -> DataFrame:
        rows = [(t["name"], t["status"], t["duration_ms"], {k: str(v) for k, v in t["details"].items()}) for t in self.trace]
        return self.ranked.sparkSession.createDataFrame(rows, "name string, status string, duration_ms long, details map<string,string>")


def _stage(trace: list[dict], name: str, began: float, status: str = "completed", **details) -> None:
    trace.append({"name": name, "status": status, "duration_ms": int((perf_counter() - began) * 1000), "details": details})


def _usage(area: str, selected: int, available: int, limit: int) -> dict:
    return {"area": area, "selected": selected, "available": available, "limit": limit, "truncated": available > limit}


def _packed(ranked: DataFrame, budget: str) -> tuple[DataFrame, dict]:
    packed = durable(capsule.build_capsules(ranked.drop("ord"), budget))
    row = packed.first()
    limit = capsule.BUDGETS[budget][0]
    usage = _usage("context_packet", row["selected"] if row else 0, row["available"] if row else 0, limit)
    return packed, usage | {"truncated": bool(row and row["truncated"]), "estimated_chars": row["estimated_chars"] if row else 0}


def query_knowledge(artifacts: DataFrame, edges: DataFrame | None, query: str, where: scope.Scope, top_k: int = 10, budget: str = "medium", vector_hits: DataFrame | None = None) -> Answer:
    """Recall, fuse, one hop of the graph from the best three, fuse again, pack, and abstain if the best match is weak.

    artifacts: artifact_id, artifact_type, wiki_id, namespace, version, canonical_name, aliases, title, summary,
    confidence, status, and provenance if there is any. vector_hits: further hits with the columns of artifact_hits;
    those of artifacts that aren't published are dropped.
    """
    if not query.strip():
        raise ValueError("a query needs words")
    trace: list[dict] = []
    _stage(trace, "trigger", perf_counter(), namespace=where.namespace, version=where.version)
    began = perf_counter()
    live = artifacts.where(scope.knowledge_filter(where, F.col("status") == "active"))
    hits, warnings = artifact_hits(live, query, top_k), []
    if vector_hits is not None:
        known = live.select(F.col("artifact_id").alias("id"))
        if not vector_hits.join(known, "id", "left_anti").isEmpty():
            warnings.append("UNPUBLISHED_KNOWLEDGE_INDEX_HIT_DROPPED")
        hits = hits.unionByName(vector_hits.join(known, "id", "left_semi"))
    hits = durable(hits)
    _stage(trace, "recall", began, knowledge_candidates=hits.count())
    began = perf_counter()
    more = [F.col("provenance")] if "provenance" in live.columns else [F.array().cast("array<struct<rag_collection_id:string,document_id:string>>").alias("provenance")]
    titles = live.select(F.col("artifact_id").alias("id"), "wiki_id", "namespace", "version", F.col("canonical_name").alias("title"), "summary", "confidence", "status", *more)
    ranked = durable(retrieval.top_ranked(retrieval.fuse_hits(hits).join(titles, "id"), top_k))
    n_graph, n_seeds = 0, 0
    if edges is None:
        warnings.append("RELATION_READER_UNAVAILABLE")
    else:
        seeds = ranked.where(F.col("rank") <= SEEDS).select(F.col("id").alias("seed_id"))
        grown = graph.expand(edges, seeds, live.select("artifact_id"), top_k)
        near = grown.join(live, grown["target_id"] == live["artifact_id"])
        found = durable(near.select(F.lit("q").alias("query_id"), F.col("artifact_type").alias("kind"), F.col("artifact_id").alias("id"), F.lit("graph").alias("channel"), F.concat(F.lit("graph:outgoing-1hop:"), "n_edges").alias("ranking"), "raw_score", (F.lit(3_000_000) + F.monotonically_increasing_id()).alias("ord"), "confidence", "status"))
        n_graph, n_seeds = found.count(), seeds.count()
        ranked = durable(retrieval.top_ranked(retrieval.fuse_hits(hits.unionByName(found)).join(titles, "id"), top_k))
    n = ranked.count()
    _stage(trace, "rerank", began, ranked_candidates=n, graph_seeds=n_seeds)
    began = perf_counter()
    packed, packet = _packed(ranked, budget)
    best = ranked.where("rank = 1").select("match_confidence").first()
    if not best:
        warnings.append("NO_RESULTS")
    elif best[0] == "weak":
        warnings.append("WEAK_MATCHES_ONLY")
    if packet["truncated"]:
        warnings.append("CONTEXT_BUDGET_TRUNCATED")
    _stage(trace, "inject", began, capsule_items=packet["selected"], estimated_tokens=packet["estimated_chars"] // 4)
    _stage(trace, "generate", perf_counter(), "delegated", owner="calling agent")
    usage = [_usage("source_parts", 0, 0, top_k), _usage("knowledge_artifacts", min(n, top_k), n, top_k), _usage("graph_context", n_graph, n_graph, top_k), packet]
    return Answer(ranked, packed, list(dict.fromkeys(warnings)), not best or best[0] == "weak", trace=trace, budget=usage)


def query_with_fallback(wiki: Answer, read_sources: Callable[[int], DataFrame], where: scope.Scope, top_k: int = 10, budget: str = "medium", schedule: Callable[[DataFrame], None] | None = None, update_wiki: bool = True, warned: tuple[str, ...] = ()) -> Answer:
    """The wiki's answer if it is reliable; else the sources, fused with the wiki's weak items, and what the wiki lacks.

    read_sources(limit) gives source hits (``fallback.source_hits``); warned are its warnings. schedule gets the
    documents by which the wiki is to be updated; if it fails, the answer says so and stands.
    """
    if not wiki.abstained:
        return replace(wiki, route=fallback.WIKI_HIT, trace=_routed(wiki.trace, fallback.WIKI_HIT, wiki.ranked.count(), 0, 0))
    began = perf_counter()
    hits = durable(read_sources(fallback.source_limit(top_k)))
    n_hits, n_wiki = hits.count(), wiki.ranked.count()
    spent = int((perf_counter() - began) * 1000)
    items = durable(fallback.source_items(hits, where.wiki_id))
    sources = durable(fallback.ranked_sources(items, top_k))
    limit = max(top_k, capsule.BUDGETS[budget][0])
    ranked = durable(fallback.merged(wiki.ranked, sources, limit))
    misses = fallback.missing_documents(hits, wiki.ranked, where.wiki_id)
    best = ranked.orderBy("rank").select("match_confidence").first()
    warnings = [*wiki.warnings, *warned, "LLM_WIKI_MISS_RAG_FALLBACK" if n_hits else "RAG_NO_RESULTS"]
    packed, packet = _packed(ranked, budget)
    if n_hits and update_wiki:
        if schedule is None:
            warnings.append("LLM_WIKI_UPDATE_NOT_CONFIGURED")
        else:
            try:
                schedule(fallback.update_documents(hits, where.wiki_id))
            except Exception:  # the answer doesn't depend on it
                warnings.append("LLM_WIKI_UPDATE_SCHEDULE_FAILED")
    route = fallback.WIKI_PLUS_RAG if n_wiki and n_hits else fallback.RAG_FALLBACK
    said = wiki.ranked.sparkSession.range(1).select(fallback.abstention(F.lit(best[0] if best else None).cast("string"), F.lit(bool(best))).alias("a")).first()["a"]
    n_sources = sources.count()
    graph_context = [u for u in wiki.budget if u["area"] == "graph_context"] or [_usage("graph_context", 0, 0, 0)]
    usage = [_usage("source_parts", n_sources, n_sources, top_k), _usage("knowledge_artifacts", min(n_wiki, top_k), n_wiki, top_k), *graph_context, packet]
    return Answer(ranked, packed, list(dict.fromkeys(warnings)), said["recommended"], said["reason"], route, _routed(wiki.trace, route, n_wiki, n_hits, spent), usage, sources, misses, fallback.enrichment_requests(hits, misses))


def _routed(trace: list[dict], route: str, n_wiki: int, n_sources: int, spent: int) -> list[dict]:
    """The trace with the route in its trigger, and in its recall what both sides gave and how long the sources took."""
    out = []
    for t in trace:
        if t["name"] == "trigger":
            t = t | {"details": t["details"] | {"route": route}}
        elif t["name"] == "recall":
            t = t | {"duration_ms": t["duration_ms"] + spent, "details": t["details"] | {"wiki_candidates": n_wiki, "rag_candidates": n_sources, "route": route}}
        out.append(t)
    return out


def query_documents(docs: DataFrame, queries: DataFrame, namespace: str, version: str, language: str | None = None, top_k: int = 10, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, id, score, rank, route): by name where a query names a document, else semantic search in the scope.

    docs: id, name, api_id, text and the scope's columns; queries: (query_id, text). Semantic search is that of dense
    vectors (dense_embedding, against ``embed`` of the query's text) if an embedder is given, else of sparse ones.
    """
    held = docs.where(scope.document_filter(namespace, version, language))
    named = retrieval.exact_names(queries, held, limit=top_k)
    rest = queries.join(named.select("query_id").distinct(), "query_id", "left_anti")
    if embed is not None:
        found = retrieval.dense_top_k(held, rest.withColumn("vector", embed(F.col("text"))), top_k, "id", "dense_embedding")
    else:
        found = retrieval.sparse_top_k(held, rest, top_k, "id")
    return named.select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank", F.lit("name").alias("route")).union(found.select("query_id", "id", "score", "rank", F.lit("semantic").alias("route")))


def query_batch(docs: DataFrame, queries: DataFrame, top_k: int = 10, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Answers of queries (query_id, text, namespace, version, language) that each have a scope of their own, and an audit
    row for each query: its strategy, how many documents it got, and its error. One bad query spoils no other.

    All scopes are answered in one plan: documents are joined to the scopes that they are in (their language's and the one
    of any language at most), and names, vectors and frequencies are compared within the scope.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = F.when(blank("text"), "EMPTY_QUERY").when(blank("namespace") | blank("version"), "SCOPE_REQUIRED")
    judged = durable(queries.withColumn("error", error))
    good = judged.where("error IS NULL").select("query_id", "text", F.col("namespace").alias("s_namespace"), F.col("version").alias("s_version"), F.when(F.col("language") != "", F.col("language")).alias("s_language"))
    where = ["s_namespace", "s_version", "s_language"]
    scopes = durable(good.select(*where).distinct().withColumn("scope_id", F.monotonically_increasing_id()))
    named_scope = (good["s_namespace"] == scopes["s_namespace"]) & (good["s_version"] == scopes["s_version"]) & good["s_language"].eqNullSafe(scopes["s_language"])
    asked = durable(good.join(scopes, named_scope).select("query_id", "text", "scope_id"))
    inside = (F.col("namespace") == F.col("s_namespace")) & (F.col("version") == F.col("s_version")) & (F.col("s_language").isNull() | (F.col("language") == F.col("s_language")))
    held = docs.where(scope.document_filter()).join(scopes, inside).drop(*where)
    named = durable(retrieval.exact_names(asked, held, limit=top_k, within="scope_id"))
    rest = asked.join(named.select("query_id").distinct(), "query_id", "left_anti")
    if embed is not None:
        found = retrieval.dense_top_k(held, rest.withColumn("vector", embed(F.col("text"))), top_k, "id", "dense_embedding", "scope_id")
    else:
        found = retrieval.scoped_sparse_top_k(held, rest, top_k, "scope_id", "id")
    found = named.select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank", F.lit("name").alias("route")).union(found.select("query_id", "id", "score", "rank", F.lit("semantic").alias("route")))
    found = durable(found)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("documents"), F.min("route").alias("strategy"))
    audit = judged.join(counts, "query_id", "left").select("query_id", "text", "namespace", "version", "language", F.coalesce("strategy", F.when(F.col("error").isNull(), "semantic")).alias("strategy"), F.coalesce("documents", F.lit(0)).alias("documents"), "error")
    return found, audit


def with_vectors(rows: DataFrame, id_col: str, dense: Column, sparse: Column, embed: Callable[[Column], Column]) -> DataFrame:
    """Rows with dense_embedding and sparse_embedding; document frequencies are those of the rows themselves."""
    texts = durable(rows.withColumn("_sparse", sparse))
    n = texts.count()
    vectors = retrieval.sparse_vectors(texts, id_col, F.col("_sparse"), retrieval.document_frequency(texts, F.col("_sparse")), n)
    maps = vectors.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token_id", "weight")))).alias("sparse_embedding"))
    found = texts.withColumn("dense_embedding", embed(dense)).drop("_sparse").join(maps, id_col, "left")
    return found.withColumn("sparse_embedding", F.coalesce("sparse_embedding", F.create_map().cast("map<int,double>")))


def build_index(files: DataFrame, table: DataFrame, ingested_at: Column, dry_run: bool = False, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The vector table after YAML files, and a record of the run (parsed, failed, duplicate, indexed, dry_run).

    All rows of an id that occurs twice in the batch are left out. With an embedder rows have their dense and sparse
    vectors. A dry run changes nothing; its record counts what would be indexed.
    """
    found, record, _ = _indexed(files, table, ingested_at, dry_run, embed)
    return found, record


def _indexed(files: DataFrame, table: DataFrame, ingested_at: Column, dry_run: bool, embed: Callable[[Column], Column] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table, the record and the parsed files; rows are counted in the pass that writes them."""
    seen, kept = Observation(), Observation()
    parsed = durable(api_documents.parse(files).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("good")))
    rows = api_documents.project(api_documents.unique(parsed.where("error IS NULL")), ingested_at)
    if embed is not None:
        rows = with_vectors(rows, "id", api_documents.dense_text(), api_documents.sparse_text(), embed)
    rows = durable(rows.observe(kept, F.count(F.lit(1)).alias("n")))
    n, good, n_indexed = seen.get.get("n", 0), seen.get.get("good", 0), kept.get.get("n", 0)
    record = files.sparkSession.createDataFrame([(good, n - good, n_indexed, good - n_indexed, dry_run)], "parsed long, failed long, indexed long, duplicate long, dry_run boolean")
    wanted = [c for c in table.columns if c in rows.columns]
    return (table if dry_run else state.upsert(table, rows.select(*wanted), ["id"])), record, parsed


def ingest(files: DataFrame, table: DataFrame, ingested_at: Column, folder: str, run_id: str, dry_run: bool = False, embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, dict]:
    """The table after a run, and the run's record with its status, which is written below a folder with the run's errors.

    The record is complete or not there, and a run has one: a second run of that id is an error.
    """
    spark, out = files.sparkSession, folder.rstrip("/")
    found, record, parsed = _indexed(files, table, ingested_at, dry_run, embed)
    counted = Observation()
    _errors(parsed).observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{out}/errors/{run_id}")
    row = _with_status(record, counted.get.get("n", 0)).first().asDict() | {"run_id": run_id}
    if not create_once(spark, f"{out}/records/{run_id}.json", json.dumps(row)):
        raise FileExistsError(f"{out}/records/{run_id}.json")
    return found, row


def index_errors(files: DataFrame) -> DataFrame:
    """(source, stage, message): files that can't be parsed, and ids that occur twice in the batch."""
    return _errors(durable(api_documents.parse(files)))


def _errors(parsed: DataFrame) -> DataFrame:
    repeated = state.duplicate_keys(parsed.where("error IS NULL"), F.col("id")).select(F.col("key").alias("source"), F.lit("duplicate").alias("stage"), F.concat(F.lit("occurs "), "n", F.lit(" times; all rows are left out")).alias("message"))
    return parsed.where("error IS NOT NULL").select(F.col("path").alias("source"), F.lit("parse").alias("stage"), F.col("error").alias("message")).union(repeated)


def run_record(record: DataFrame, errors: DataFrame) -> DataFrame:
    """A record of a run with the number of its errors and its status."""
    return _with_status(record, errors.count())


def _with_status(record: DataFrame, n: int) -> DataFrame:
    status = F.when((F.col("parsed") == 0) | (~F.col("dry_run") & (F.col("indexed") == 0)), "failed").when(F.lit(n > 0), "partial").when(F.col("dry_run"), "dry_run").otherwise("succeeded")
    return record.withColumn("errors", F.lit(n)).withColumn("status", status)


def index_preview(files: DataFrame, ingested_at: Column) -> DataFrame:
    """(path, id, fields, error): what each document of YAML files would become, as JSON; vectors are not made."""
    parsed = api_documents.parse(files)
    rows = api_documents.project(parsed.where("error IS NULL"), ingested_at)
    shown = rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "id"])).alias("fields"))
    return parsed.select("path", "id", "error").join(shown, "id", "left")


def artifact_rows(artifacts: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Active artifacts (ARTIFACT columns, source_revision_id and versions if there are any) as rows of the knowledge index:
    scalar fields, claims, relations and provenance as JSON, dense and sparse vectors. No text to index is an error."""
    d = F.col("draft")
    text = catalog.index_text(d)
    text = F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.raise_error(F.concat(F.lit("no text to index: "), "artifact_revision_id"))).otherwise(text)
    said = [c for c in ("source_revision_id", "extractor_version", "prompt_version", "model", "schema_version") if c in artifacts.columns]
    rows = artifacts.select(
        "artifact_id", "artifact_revision_id", d["artifact_type"].alias("artifact_type"), "wiki_id", d["namespace"].alias("namespace"), d["version"].alias("version"), d["canonical_name"].alias("canonical_name"), d["aliases"].alias("aliases"), "status", "source_ids",
        d["title"].alias("title"), d["summary"].alias("summary"), F.to_json(d["claims"]).alias("claims_json"), F.to_json(d["related_artifacts"]).alias("relations_json"), F.to_json(F.struct("wiki_id", "source_ids", *said)).alias("provenance_json"), text.alias("_text"),
    )
    return with_vectors(rows, "artifact_id", F.col("_text"), F.col("_text"), embed).drop("_text")


def reindex(artifacts: DataFrame, index: DataFrame, where: scope.Scope, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sparse index rows (id, scope, token_id, weight) with a scope rebuilt, and what differed before (id, problem).

    Artifact ids that the catalog returns twice are an error, and nothing is rebuilt; a dry run leaves the index.
    """
    live = artifacts.where(scope.knowledge_filter(where, F.col("status") == "active"))
    if repeated := [r["key"] for r in state.duplicate_keys(live, F.col("artifact_id")).orderBy("key").limit(5).collect()]:
        raise ValueError(f"the catalog has these artifacts twice: {repeated}")
    own = index.where(scope.knowledge_filter(where))
    problems = state.index_consistency(live.select(F.col("artifact_id").alias("id")), own.select("id").distinct())
    if dry_run:
        return index, problems
    text = F.concat_ws("\n", "canonical_name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "\n"), "title", "summary")
    vectors = retrieval.sparse_vectors(live, "artifact_id", text, retrieval.document_frequency(live, text), live.count())
    fresh = vectors.select(F.col("artifact_id").alias("id"), F.lit(where.wiki_id).alias("wiki_id"), F.lit(where.namespace).alias("namespace"), F.lit(where.version).alias("version"), "token_id", "weight")
    return index.where(~scope.knowledge_filter(where)).unionByName(fresh), problems


def reindex_report(artifacts: DataFrame, problems: DataFrame, where: scope.Scope, batch_size: int = 100, dry_run: bool = False) -> dict:
    """Status, counts and warnings of a rebuild."""
    if batch_size < 1:
        raise ValueError("a batch has a row at least")
    n = artifacts.where(scope.knowledge_filter(where, F.col("status") == "active")).count()
    return {"status": "dry_run" if dry_run else "succeeded", "discovered": n, "indexed": 0 if dry_run else n, "batches": 0 if dry_run else -(-n // batch_size), "problems": problems.count(), "warnings": ["DRY_RUN_NO_INDEX_WRITE"] if dry_run else []}


#: Parts of an index key are joined, and a scope's keys end before, these characters.
KEY_UNIT, KEY_END = "\x1f", "\x20"
INDEX = (
    "key string, artifact_id string, artifact_revision_id string, artifact_type string, wiki_id string, namespace string, version string, canonical_name string, aliases array<string>, status string, source_ids array<string>, "
    "title string, summary string, claims_json string, relations_json string, provenance_json string, dense_embedding array<float>, sparse_embedding map<int,double>"
)


class ArtifactIndex:
    """The index of artifacts as a table of key ranges: dense and sparse vectors side by side, a scope's rows together."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], rows: int = ranged.ROWS):
        self.embed, self.table = embed, ranged.RangedTable(spark, folder, INDEX, "key", rows)

    def _rows(self, artifacts: DataFrame) -> DataFrame:
        made = artifact_rows(artifacts, self.embed)
        own = made.withColumn("key", F.concat_ws(KEY_UNIT, "wiki_id", "namespace", "version", "artifact_id"))
        return own.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.table.schema])

    def upsert(self, artifacts: DataFrame) -> tuple[int, list[str]]:
        """Put active artifacts in place of those of their ids; document frequencies are those of these artifacts."""
        return self.table.upsert(self._rows(artifacts))

    def remove(self, artifacts: DataFrame) -> tuple[int, list[str]]:
        """Take artifacts (wiki_id, namespace, version, artifact_id) out."""
        keys = artifacts.select(F.concat_ws(KEY_UNIT, "wiki_id", "namespace", "version", "artifact_id").alias("key")).distinct()
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.table.schema if f.name != "key"]
        return self.table.upsert(keys.select("key", *blank), F.lit(True))

    def _bounds(self, where: scope.Scope) -> tuple[str, str]:
        begins = KEY_UNIT.join([where.wiki_id, where.namespace, where.version])
        return begins + KEY_UNIT, begins + KEY_END

    def rebuild(self, artifacts: DataFrame, where: scope.Scope) -> tuple[int, list[str]]:
        """A scope's rows anew from its active artifacts, dense and sparse vectors together; other scopes stay as they are."""
        live = artifacts.where((F.col("wiki_id") == where.wiki_id) & (F.col("draft.namespace") == where.namespace) & (F.col("draft.version") == where.version) & (F.col("status") == "active"))
        return self.table.replace(*self._bounds(where), self._rows(live))

    def of(self, where: scope.Scope) -> DataFrame:
        return self.table.between(*self._bounds(where))


def extract_artifacts(sections: DataFrame) -> DataFrame:
    """A rule-based stand-in for model extraction: each section (document_id, namespace, version, title, body) is a concept."""
    claim = F.struct(F.substring_index("body", "\n", 1).alias("text"), F.lit("medium").alias("confidence"))
    return sections.select("document_id", "namespace", "version", F.lit("concept").alias("artifact_type"), F.trim("title").alias("canonical_name"), F.array(claim).alias("claims"))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a dense model: signed word hashes, normalized to length 1."""
    from corvia.functions.text import words

    parts = F.transform(words(text), lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("at"), F.when(F.pmod(F.xxhash64(F.lit(1), w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(parts, lambda p: p["at"] == i), F.lit(0.0), lambda a, p: a + p["x"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))


EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hash": hash_embedding}


def profile_schema(fields: list[dict]) -> T.StructType:
    """A table's schema from its logical description: name, type (DDL), and index, metric, dimension as metadata."""
    return T.StructType([T.StructField(f["name"], T._parse_datatype_string(f["type"]), f.get("nullable", True), {k: f[k] for k in ("indexed", "metric", "dimension", "source") if k in f}) for f in fields])


@dataclass(frozen=True)
class Profile:
    """What belongs to a kind of collection: its schema, its embedder and how many documents a search gives."""

    name: str
    schema: T.StructType
    embedder: str = "hash"
    top_k: int = 10

    def embed(self, text: Column) -> Column:
        return EMBEDDERS[self.embedder](text)


class Profiles:
    """Profiles by name; a collection takes its own, else the default."""

    def __init__(self, default: Profile, *others: Profile, collections: dict[str, str] | None = None):
        self.default, self.by_name, self.collections = default, {p.name: p for p in (default, *others)}, dict(collections or {})

    def resolve(self, name: str | None = None, collection: str | None = None) -> Profile:
        wanted = name or self.collections.get(collection or "", self.default.name)
        if wanted not in self.by_name:
            raise KeyError(f"no profile {wanted}; there are {sorted(self.by_name)}")
        return self.by_name[wanted]


def update_knowledge(sources: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources with their outcome, and the counts of a run: only created and updated ones go on to extraction."""
    judged = catalog.updates_due(sources, known)
    return judged, judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def batch_top(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query of a batch."""
    return top_per(hits, ["query_id"], k, [F.desc("score"), F.col("id")])


#: An answer flow: (questions, contexts) -> (question_id, answer). Model calls are left to others; these stand in for them.
AnswerFlow = Callable[[DataFrame, DataFrame], DataFrame]


def answered(questions: DataFrame, contexts: DataFrame, most: int = 600) -> DataFrame:
    """(question_id, answer, sources): the first sentence of each of a question's contexts, in order; a deterministic
    stand-in for a model that answers from what it is given.

    contexts: question_id, source, text, rank. A question without any context says so.
    """
    lead = F.regexp_extract("text", r"(?s)^\s*(.*?[.!?。！？](?=\s|$)|.*)", 1)
    some = contexts.withColumn("_lead", F.trim(lead)).where("_lead <> ''")
    held = top_per(some, ["question_id"], 5, [F.col("rank"), F.col("source")], "_r").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("_r", "_lead", "source"))).alias("_c"))
    joined = questions.join(held, "question_id", "left")
    text = F.array_join(F.transform("_c", lambda c: c["_lead"]), " ")
    return joined.select("question_id", F.coalesce(F.substring(text, 1, most), F.lit("There is no context for this question.")).alias("answer"), F.coalesce(F.transform("_c", lambda c: c["source"]), F.array().cast("array<string>")).alias("sources"))


def direct_flow(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Answers without any context."""
    return answered(questions, contexts.limit(0))


def retrieved_flow(docs: DataFrame, k: int = 5) -> AnswerFlow:
    """Answers from the k documents (id, text) that sparse search finds for a question."""

    def flow(questions: DataFrame, contexts: DataFrame) -> DataFrame:
        found = retrieval.sparse_top_k(docs, questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text")), k, "id")
        rows = found.join(docs.select("id", "text"), "id").select(F.col("query_id").alias("question_id"), F.col("id").cast("string").alias("source"), "text", "rank")
        return answered(questions, rows)

    return flow


def given_flow(documents: DataFrame) -> AnswerFlow:
    """Answers from the documents (document_id, content) that a question names (document_ids), in its order."""

    def flow(questions: DataFrame, contexts: DataFrame) -> DataFrame:
        wanted = questions.select("question_id", F.posexplode("document_ids").alias("rank", "document_id"))
        rows = wanted.join(documents, "document_id").select("question_id", F.col("document_id").alias("source"), F.col("content").alias("text"), "rank")
        return answered(questions, rows)

    return flow


FLOWS: dict[str, Callable[..., AnswerFlow]] = {"direct": lambda: direct_flow, "retrieved": retrieved_flow, "given": given_flow}


def test_set_rounds(documents: DataFrame, groups: DataFrame, used: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(round, filename, mode, selected): one question's documents for each unused document, dealt to rounds in turn.

    One in ten is a comparison, with one or two others of its group; the others stand alone or, one in ten, with up to
    two related ones of their group. All draws are by hash, so a run that is resumed draws the same.
    """
    from corvia.operators import cases

    fresh = documents.join(used.select("filename").distinct(), "filename", "left_anti")
    dealt = cases.allocate(fresh, rounds, seed)
    beside = groups.select("group_id", F.explode("files").alias("filename")).join(groups.select("group_id", F.explode("files").alias("other")), "group_id").where("filename <> other")
    order = F.xxhash64(F.lit(seed), "filename", "other")
    others = top_per(beside.select("filename", "other").distinct(), ["filename"], 2, [order, F.col("other")], "_r").groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("_r", "other"))).alias("_o"))
    mode = cases.draw_mode(F.col("filename"), seed)
    widened = cases.draw_mode(F.col("filename"), seed + 1) == "comparison"
    n = F.when(mode == "comparison", 1 + F.pmod(F.xxhash64(F.lit(seed + 2), "filename"), F.lit(2))).when(widened, 2).otherwise(0)
    some = F.slice(F.transform(F.coalesce("_o", F.array().cast("array<struct<_r:int,other:string>>")), lambda o: o["other"]), 1, n.cast("int"))
    found = dealt.join(others, "filename", "left").withColumn("selected", F.concat(F.array("filename"), some))
    kind = F.when(F.size("selected") == 1, "single").when(mode == "comparison", "comparison").otherwise("mixed")
    return found.select("round", "filename", kind.alias("mode"), "selected")
