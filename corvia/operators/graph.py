"""The relation graph: edges from relations, statistics, one-hop expansion, export, incremental upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.functions import scoring
from corvia.functions.text import edge_id
from corvia.operators.ranking import batches, top_per
from corvia.tables import durable

PAIR = ["_low", "_high"]


def resolve(relations: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Relations (source_id, target_name, relation_type, quote, namespace, version, target_namespace, target_version) with target_id.

    Relations out of their scope and those without a target are dropped. Of several artifacts of a name the last by
    id is the target.
    """
    scope = (F.col("target_namespace") == F.col("namespace")) & (F.col("target_version") == F.col("version"))
    named = artifacts.groupBy("namespace", "version", F.col("canonical_name").alias("target_name")).agg(F.max("artifact_id").alias("target_id"))
    return relations.where(scope).join(named, ["namespace", "version", "target_name"])


def build_edges(relations: DataFrame, wiki_id: str) -> DataFrame:
    """Scored edges from relations (source_id, target_id, target_name, relation_type, quote).

    Pair density counts all relations between two artifacts, in either direction; an edge has a reverse if the same
    relation type leads back (a loop is its own). Edges of one (source, target, type) are one edge, the last by quote.
    Broken edges (under 0.2) are dropped. Relations are shuffled once, by pair, and sorted once there: edges, densities
    and reverses all follow from that order, row by row. (Summing relations up before the shuffle would sort every
    task's whole input, since the last of texts has no sum of fixed width.)
    """
    key = ["source_id", "target_id", "relation_type"]
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    met = relations.where("source_id IS NOT NULL OR target_id IS NOT NULL").select(*key, "target_name", "quote", low.alias("_low"), high.alias("_high")).repartition(*PAIR)
    order = [*PAIR, "relation_type", "source_id", "target_id"]
    edges = met.groupBy(*order).agg(F.max("target_name").alias("target_name"), F.max("quote").alias("quote"), F.count(F.lit(1)).alias("_n"))
    of_pair = Window.partitionBy(*PAIR).orderBy("relation_type").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.withColumn("density_count", F.sum("_n").over(of_pair)).withColumn("_ways", F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "relation_type")))
    edges = edges.withColumn("has_reverse", (F.col("source_id") == F.col("target_id")) | (F.col("_ways") == 2)).drop("_ways", "_n", *PAIR)
    edges = edges.select(*key, "target_name", "quote", "density_count", "has_reverse")
    parts = scoring.breakdown(F.col("relation_type"), F.col("target_name"), F.col("has_reverse"), F.col("quote"), F.col("density_count"))
    edges = edges.withColumn("breakdown", parts).withColumn("strength_score", scoring.score(F.col("breakdown")))
    edges = edges.where(~scoring.broken(F.col("strength_score"))).withColumn("strength_tier", scoring.tier(F.col("strength_score")))
    own = edge_id(F.lit(wiki_id), F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("relation_type"))
    back = edge_id(F.lit(wiki_id), F.col("target_id").cast("string"), F.col("source_id").cast("string"), F.col("relation_type"))
    return edges.withColumn("edge_id", own).withColumn("reverse_edge_id", F.when(F.col("has_reverse"), back)).withColumn("direction", scoring.direction(F.col("relation_type")))


def upsert_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored edges with fresh ones in place of those of the same id; broken ones are dropped."""
    fresh = fresh.where(~scoring.broken(F.col("strength_score")))
    return stored.join(fresh.select("edge_id"), "edge_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_artifacts(stored: DataFrame, relations: DataFrame, changed: DataFrame, wiki_id: str) -> DataFrame:
    """Rebuild the outgoing edges of changed artifacts (artifact_id) against the rest of the graph.

    A (source, target, type) counts once; density is the stored undirected count of the pair and one; a reverse is
    looked up in what is stored.
    """
    rest = stored.join(changed.withColumnRenamed("artifact_id", "source_id"), "source_id", "left_anti")
    key = ["source_id", "target_id", "relation_type"]
    new = relations.join(changed.withColumnRenamed("artifact_id", "source_id"), "source_id", "left_semi").dropDuplicates(key)
    low, high = F.least("source_id", "target_id").alias("_low"), F.greatest("source_id", "target_id").alias("_high")
    pairs = rest.where("source_id <> target_id").groupBy(low, high).agg(F.count(F.lit(1)).alias("_stored"))
    back = rest.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), "relation_type").withColumn("_back", F.lit(True)).distinct()
    new = new.withColumn("_low", F.least("source_id", "target_id")).withColumn("_high", F.greatest("source_id", "target_id"))
    new = new.join(pairs, PAIR, "left").join(back, key, "left").withColumn("density_count", F.coalesce("_stored", F.lit(0)) + 1).withColumn("has_reverse", F.coalesce("_back", F.lit(False)))
    new = new.drop(*PAIR, "_stored", "_back")
    parts = scoring.breakdown(F.col("relation_type"), F.col("target_name"), F.col("has_reverse"), F.col("quote"), F.col("density_count"))
    new = new.withColumn("breakdown", parts).withColumn("strength_score", scoring.score(F.col("breakdown"))).withColumn("strength_tier", scoring.tier(F.col("strength_score")))
    own = edge_id(F.lit(wiki_id), F.col("source_id").cast("string"), F.col("target_id").cast("string"), F.col("relation_type"))
    return upsert_edges(rest, new.withColumn("edge_id", own).withColumn("direction", scoring.direction(F.col("relation_type"))))


def delete_for(edges: DataFrame, artifacts: DataFrame, role: str = "either") -> DataFrame:
    """Edges without those whose source, target or either is among the artifacts (artifact_id)."""
    found = edges
    for side in ("source", "target"):
        if role in (side, "either"):
            found = found.join(artifacts.select(F.col("artifact_id").alias(f"{side}_id")), f"{side}_id", "left_anti")
    return found


def outgoing(edges: DataFrame, source: Column, limit: int = 20, incoming: bool = False) -> DataFrame:
    """An artifact's edges, strongest first, ties by id."""
    side = "target_id" if incoming else "source_id"
    return edges.where(F.col(side) == source).orderBy(F.desc("strength_score"), "edge_id").limit(limit)


def listed(edges: DataFrame, least: float = scoring.BROKEN) -> DataFrame:
    return edges.where(F.col("strength_score") >= least)


def nodes(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) of all endpoints, in one pass over the edges."""
    ends = F.array(F.struct(F.col("source_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def stats(edges: DataFrame) -> DataFrame:
    """(measure, key, value): edges, nodes, edges by type and tier, and orphans (none: nodes are endpoints)."""
    long = lambda measure, key, n: (F.lit(measure).alias("measure"), key.alias("key"), n.cast("long").alias("value"))
    n = F.count(F.lit(1))
    edges = durable(edges.select("source_id", "target_id", "relation_type", "strength_tier"))  # read twice
    cube = durable(edges.groupBy("relation_type", "strength_tier").agg(n.alias("n")))  # small: summed up again below
    found = cube.select(*long("edges", F.lit("all"), F.col("n"))).groupBy("measure", "key").agg(F.sum("value").alias("value"))
    for column, measure in (("relation_type", "by_type"), ("strength_tier", "by_tier")):
        found = found.union(cube.groupBy(column).agg(F.sum("n").alias("n")).select(*long(measure, F.col(column), F.col("n"))))
    counted = durable(nodes(edges).agg(n.alias("n"), F.count_if((F.col("in_degree") == 0) & (F.col("out_degree") == 0)).alias("o")))
    return found.union(counted.select(*long("nodes", F.lit("all"), F.col("n")))).union(counted.select(*long("orphans", F.lit("all"), F.col("o"))))


def degree_top(edges: DataFrame, k: int, side: str = "out") -> DataFrame:
    """The k nodes of the highest degree, ties by id."""
    return nodes(edges).where(F.col(f"{side}_degree") > 0).select("node", F.col(f"{side}_degree").alias("degree")).orderBy(F.desc("degree"), "node").limit(max(0, k))


def expand(edges: DataFrame, seeds: DataFrame, active: DataFrame, limit: int, n_seeds: int | None = None) -> DataFrame:
    """(target_id, raw_score, n_edges, relations): one hop out from the seeds (seed_id), strongest targets first.

    Every seed has max(1, limit / seeds) edges, by score and then id. A target's score is that of its strongest edge;
    targets that aren't active (artifact_id) are dropped. Directed relations are shown from the target's side.
    """
    n_seeds = n_seeds or seeds.count()
    out = edges.join(F.broadcast(seeds.select(F.col("seed_id").alias("source_id"))), "source_id") if n_seeds <= 1000 else edges.join(seeds.select(F.col("seed_id").alias("source_id")), "source_id")
    out = top_per(out, ["source_id"], max(1, limit // max(1, n_seeds)), [F.desc("strength_score"), F.col("edge_id")], "_r").drop("_r")
    out = out.where(~scoring.broken(F.col("strength_score")))
    shown = F.when(F.col("direction") == "directed", scoring.inverse(F.col("relation_type"))).otherwise(F.col("relation_type"))
    found = out.groupBy("target_id").agg(F.max("strength_score").alias("raw_score"), F.count(F.lit(1)).alias("n_edges"), F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("target_id"), shown.alias("relation")))).alias("relations"))
    found = found.join(active.select(F.col("artifact_id").alias("target_id")).distinct(), "target_id", "left_semi")
    return found.orderBy(F.desc("raw_score"), "target_id").limit(limit)


def export_batches(edges: DataFrame, size: int) -> DataFrame:
    """(batch, edges, nodes, is_last, payload): edges by id in batches with their own statistics; payload is JSON.

    An empty graph has one empty batch. The edges are written once and read from there for the numbers, the rows and
    the count; which batch is the last follows from the count.
    """
    edges = durable(edges.select("edge_id", "source_id", "target_id", "relation_type", "strength_tier", "strength_score", "reverse_edge_id"))
    n = edges.count()
    if not n:
        return edges.sparkSession.createDataFrame([(0, 0, 0, "[]", {}, {}, True)], "batch long, edges long, nodes long, payload string, by_type map<string,long>, by_tier map<string,long>, is_last boolean")
    numbered = batches(edges, size, F.substring("edge_id", 1, 8), [F.col("edge_id")])
    payload = F.struct("edge_id", "source_id", "target_id", "relation_type", F.round("strength_score", 4).alias("strength_score"), scoring.ten_point(F.col("strength_score")).alias("ten_point"), F.col("reverse_edge_id").isNotNull().alias("has_reverse"))
    ends = F.array_distinct(F.flatten(F.collect_list(F.array(F.col("source_id").cast("string"), F.col("target_id").cast("string")))))
    counts = lambda column, values: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.count_if(F.col(column) == v) for v in values])), lambda _, v: v > 0)
    found = numbered.groupBy("batch").agg(F.count(F.lit(1)).alias("edges"), F.size(ends).cast("long").alias("nodes"), F.to_json(F.array_sort(F.collect_list(payload))).alias("payload"), F.collect_list("relation_type").alias("_types"), counts("strength_tier", [t for _, t in scoring.TIERS]).alias("by_tier"))
    tally = F.map_from_entries(F.transform(F.array_distinct("_types"), lambda t: F.struct(t, F.size(F.filter("_types", lambda x: x == t)).cast("long"))))
    return found.select("batch", "edges", "nodes", "payload", tally.alias("by_type"), "by_tier", (F.col("batch") == (n - 1) // size).alias("is_last"))


def export_graph(edges: DataFrame, scope: dict[str, str] | None = None) -> DataFrame:
    """The graph as JSON lines' parts (part, json): node rows and edge rows, to be written as files rather than collected;
    with a scope, a row of it and one of the statistics come on top."""
    node_rows = nodes(edges).select(F.lit("node").alias("part"), F.to_json(F.struct(F.col("node").cast("string").alias("id"), "in_degree", "out_degree")).alias("json"))
    edge_rows = edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("edge_id", "source_id", "target_id", "relation_type", F.round("strength_score", 4).alias("score"))).alias("json"))
    found = node_rows.union(edge_rows)
    if scope is None:
        return found
    counted = stats(edges).where("measure <> 'orphans'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "measure", "key").alias("k"), "value")))).alias("stats"))
    own = edges.sparkSession.createDataFrame([(scope,)], "scope map<string,string>")
    return own.select(F.lit("scope").alias("part"), F.to_json("scope").alias("json")).union(counted.select(F.lit("stats"), F.to_json("stats"))).union(found)


def has_reverse(edges: DataFrame) -> DataFrame:
    """Edges whose relation type leads back too."""
    back = edges.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id"), "relation_type")
    return edges.join(back, ["source_id", "target_id", "relation_type"], "left_semi")


def pair_counts(edges: DataFrame) -> DataFrame:
    """(low, high, n): edges between two different artifacts, in either direction."""
    return edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high")).agg(F.count(F.lit(1)).alias("n"))
