"""Queries of the relation graph: line items as relations, part and supplier keys as artifacts of one id space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvia.operators import graph
from corvia.plans.registry import query, table

EDGES = """
rel AS (
  SELECT 'n' || l_partkey AS s, 'n' || l_suppkey AS t, CASE WHEN l_suppkey % 2 = 0 THEN 'supplier.' || l_suppkey ELSE 'supplier' END AS name,
         CASE l_returnflag WHEN 'R' THEN 'depends_on' WHEN 'A' THEN 'references' ELSE 'hierarchy' END AS type, CASE l_linestatus WHEN 'O' THEN '参见' ELSE '必须' END AS quote FROM lineitem
), counted AS (
  SELECT s, t, type, max(name) AS name, max(quote) AS quote, count(*) AS n FROM rel GROUP BY s, t, type
), pair AS (
  SELECT least(s, t) AS a, greatest(s, t) AS b, sum(n) AS density FROM counted GROUP BY ALL
), scored AS (
  SELECT c.*, density, (c.s = c.t OR r.s IS NOT NULL) AS has_reverse,
         0.35::DOUBLE * CASE c.type WHEN 'depends_on' THEN 0.9::DOUBLE WHEN 'references' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END
         + 0.25::DOUBLE * CASE WHEN contains(c.name, '.') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
         + 0.20::DOUBLE * CASE WHEN c.s = c.t OR r.s IS NOT NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
         + 0.15::DOUBLE * CASE WHEN contains(c.quote, '必须') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
         + 0.05::DOUBLE * CASE WHEN density >= 3 THEN 1.0::DOUBLE WHEN density = 2 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END AS score
  FROM counted c JOIN pair ON a = least(c.s, c.t) AND b = greatest(c.s, c.t) LEFT JOIN counted r ON r.s = c.t AND r.t = c.s AND r.type = c.type
), edges AS (
  SELECT 'edge_' || sha256(concat_ws(chr(31), 'w', s, t, type)) AS edge_id, s AS source_id, t AS target_id, type AS relation_type, round(score, 6) AS strength_score,
         CASE WHEN score >= 0.8 THEN 'strong' WHEN score >= 0.5 THEN 'moderate' WHEN score >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength_tier, density::BIGINT AS density_count,
         CASE WHEN has_reverse THEN 'edge_' || sha256(concat_ws(chr(31), 'w', t, s, type)) END AS reverse_edge_id, CASE WHEN type = 'references' THEN 'undirected' ELSE 'directed' END AS direction
  FROM scored WHERE score >= 0.2
), ends AS (
  SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT source_id AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) GROUP BY node
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    relation = F.when(F.col("l_returnflag") == "R", "depends_on").when(F.col("l_returnflag") == "A", "references").otherwise("hierarchy")
    name = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("supplier."), "l_suppkey")).otherwise("supplier")
    relations = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("n"), "l_partkey").alias("source_id"), F.concat(F.lit("n"), "l_suppkey").alias("target_id"), name.alias("target_name"), relation.alias("relation_type"), F.when(F.col("l_linestatus") == "O", "参见").otherwise("必须").alias("quote"))
    return graph.build_edges(relations, "w")


@query(f"WITH {EDGES} SELECT edge_id, source_id, target_id, relation_type, strength_score, strength_tier, density_count, reverse_edge_id, direction FROM edges")
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir)
    return found.select("edge_id", "source_id", "target_id", "relation_type", F.round("strength_score", 6).alias("strength_score"), "strength_tier", "density_count", "reverse_edge_id", "direction")


@query(f"""
WITH {EDGES}
SELECT 'edges' AS measure, 'all' AS key, count(*) AS value FROM edges
UNION ALL SELECT 'by_type', relation_type, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT 'by_tier', strength_tier, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT 'nodes', 'all', count(*) FROM ends
UNION ALL SELECT 'orphans', 'all', 0
""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT node, out_degree AS degree FROM ends WHERE out_degree > 0 ORDER BY out_degree DESC, node LIMIT 20")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_top(edges(spark, sf_dir), 20)


@query(f"""
WITH {EDGES}, seeds AS (SELECT node FROM ends ORDER BY out_degree DESC, node LIMIT 3), picked AS (
  SELECT * FROM edges WHERE source_id IN (SELECT node FROM seeds) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY strength_score DESC, edge_id) <= 4
)
SELECT target_id, max(strength_score) AS raw_score, count(*) AS n_edges FROM picked WHERE target_id IN (SELECT 'n' || s_suppkey FROM supplier) GROUP BY target_id ORDER BY raw_score DESC, target_id LIMIT 12
""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edges(spark, sf_dir).withColumn("strength_score", F.round("strength_score", 6))
    seeds = graph.degree_top(found, 3).select(F.col("node").alias("seed_id"))
    active = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), "s_suppkey").alias("artifact_id"))
    return graph.expand(found, seeds, active, 12, 3).select("target_id", "raw_score", "n_edges")


@query(f"""
WITH {EDGES}, numbered AS (SELECT *, (row_number() OVER (ORDER BY edge_id) - 1) // 1000 AS batch FROM edges)
SELECT batch, count(*) AS edges, (SELECT count(DISTINCT node) FROM (SELECT source_id AS node FROM numbered x WHERE x.batch = n.batch UNION ALL SELECT target_id FROM numbered x WHERE x.batch = n.batch)) AS nodes,
       batch = (SELECT max(batch) FROM numbered) AS is_last FROM numbered n GROUP BY batch
""")
def graph_export_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.export_batches(edges(spark, sf_dir), 1000).select("batch", "edges", "nodes", "is_last")


@query(f"""WITH {EDGES} SELECT edge_id FROM edges WHERE reverse_edge_id IS NOT NULL""")
def graph_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.has_reverse(edges(spark, sf_dir)).select("edge_id")


@query(f"""
WITH {EDGES} SELECT least(source_id, target_id) AS low, greatest(source_id, target_id) AS high, count(*) AS n FROM edges WHERE source_id <> target_id GROUP BY ALL
""")
def graph_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pair_counts(edges(spark, sf_dir))


@query(f"""
WITH {EDGES} SELECT edge_id FROM edges WHERE source_id NOT IN (SELECT 'n' || s_suppkey FROM supplier WHERE s_acctbal < 0)
""")
def graph_delete_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("n"), "s_suppkey").alias("artifact_id"))
    return graph.delete_for(edges(spark, sf_dir), gone, "source").select("edge_id")
