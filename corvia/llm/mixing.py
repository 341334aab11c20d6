"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words: a fixed multiple of all words is shared by weight, no source gets more than
``most`` times its own, and what that leaves over is shared again by weight. Within a source each document is expected
target / size copies; the expected copies are summed up along the source, a random offset is added, and a document is
emitted once for each integer boundary that its interval crosses. The order along a source is by size, so that the
copies of every size class follow the rate and the words taken miss the target by less than the longest document.

The prefix sum is a rank times the rate; ranks come from counts per block (2 % classes of size times a salt), so the
hot source is numbered by many tasks. A source's one offset is hashed from the seed and the source, so reruns agree.

Defined results: null texts have size 0; a null source is a source of its own, the last one; repeated rows are sampled
one by one; columns of other names are carried along as they are (in a struct, where none can clash with a working column),
columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import durable, n_words_of, quoted, source_key, sums_before

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SALTS = 64
#: Up to so many sources their one row each is broadcast; beyond it they are joined by shuffle.
FEW_SOURCES = 10_000
RESULTS = ["size", "source_size", "target", "copies", "taken"]


def unit_hash(*parts: Column) -> Column:
    """A number from 0 to 1 from 48 bits of an MD5."""
    hashed = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def size_class(size: Column) -> Column:
    """Sizes under 64 alone, larger ones by their leading seven bits: at most 64 classes for each power of two."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return shift * 1024 + F.floor(size / F.pow(F.lit(2.0), shift)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(_key, source_size, target) for each source.

    With ceilings c and weights w, target = min(c, level * w). Sources reach their ceiling in the order of c / w, so
    the level is that of the first source, in this order, that stays below its own. Sums along the sources are taken
    within ranges of them, so any number of sources will do; sums are of whole numbers, so no order changes them.
    """
    per = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    goal, one = share, F.lit(1).cast("long")
    placed = sums_before(per, [F.col("_key")], {"_before": one})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_before") % len(weights)).cast("int") + 1)
    placed = placed.withColumn("w", weight.cast("double")).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    whole = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    order = [F.col("ceiling") / F.col("w"), F.col("_key")]
    found = durable(sums_before(placed, order, {"full": F.col("ceiling"), "_w_before": F.col("w")}))
    found = found.withColumn("at", (F.lit(float(whole["n"]) * goal) - F.col("full")) / (F.lit(float(whole["w"])) - F.col("_w_before")))
    first = found.where(F.col("at") * F.col("w") <= F.col("ceiling")).agg(F.min(F.struct(F.col("ceiling") / F.col("w"), "_key", "at"))["at"].alias("level")).first()["level"]
    target = F.col("ceiling") if first is None else F.least(F.col("ceiling"), F.lit(first) * F.col("w"))
    return found.select("_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, size: Column | None = None) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken (copies times size)."""
    size = n_words_of(F.col("text")) if size is None else size
    kept = [c for c in docs.columns if c not in RESULTS]
    sized = docs.select(F.struct(*[quoted(c) for c in kept]).alias("_doc"), F.col("doc_id").alias("_id"), size.alias("size"), source_key(F.col("source")).alias("_key"))
    id_text = F.coalesce(F.col("_id").cast("string"), F.lit("-"))
    sized = sized.withColumn("_class", size_class(F.col("size"))).withColumn("_at", unit_hash(F.lit(str(seed)), id_text))
    sized = sized.withColumn("_salt", F.floor(F.col("_at") * SALTS).cast("int"))
    narrow = durable(sized.groupBy("_key", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("size")))
    before = Window.partitionBy("_key").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = narrow.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    per_source = targets(narrow, weights, share, most)
    few = narrow.select("_key").distinct().count() <= FEW_SOURCES
    blocks = blocks.drop("size", "_n").join(F.broadcast(per_source) if few else per_source, "_key")
    numbered = sized.withColumn("_in", F.row_number().over(Window.partitionBy("_key", "_class", "_salt").orderBy("size", "_at", "_id")))
    numbered = numbered.join(blocks, ["_key", "_class", "_salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    numbered = numbered.withColumn("_rate", rate).withColumn("_rank", F.col("_before") + F.col("_in"))

    passed = lambda rank: F.floor(rank * F.col("_rate") + unit_hash(F.lit(f"offset{seed}"), F.col("_key")))
    found = numbered.withColumn("copies", (passed(F.col("_rank")) - passed(F.col("_rank") - 1)).cast("long"))
    return found.withColumn("taken", F.col("copies") * F.col("size")).select("_doc.*", *RESULTS)


def emit(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Each document as often as the mix takes it; all columns of docs as they were."""
    whole = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("doc"), "doc_id", "source", n_words_of(F.col("text")).alias("words"))
    mixed = mix(whole, seed, size=F.col("words"))
    taken = mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select("doc.*")


def query(docs: DataFrame) -> DataFrame:
    sized = durable(docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size")))
    return mix(sized, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '-')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS pos
  FROM documents
), classed AS (
  SELECT *, greatest(length(bin(size)) - 7, 0) AS shift, floor(pos * 64)::INT AS salt FROM sized
), numbered AS (
  SELECT doc_id, k, size, row_number() OVER (PARTITION BY k ORDER BY shift * 1024 + floor(size / pow(2.0, shift))::BIGINT, salt, size, pos, doc_id) AS r
  FROM classed
), per AS (
  SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w, source_size * 2.0::DOUBLE AS ceiling,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS goal FROM per
), leveled AS (
  SELECT *, (goal - coalesce(sum(ceiling) OVER (ORDER BY ceiling / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY ceiling / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed
), aimed AS (
  SELECT k, source_size, least(ceiling, coalesce((SELECT arg_min(lvl, (ceiling / w, k)) FROM leveled WHERE lvl * w <= ceiling) * w, ceiling)) AS target FROM leveled
), rated AS (
  SELECT k, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM aimed
), chosen AS (
  SELECT k, ('0x' || substr(md5('offset7:' || k), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS o FROM rated
)
SELECT doc_id, size, source_size, target, ((floor(r * rate + o) - floor((r - 1) * rate + o))::BIGINT * size)::BIGINT AS taken
FROM numbered JOIN rated USING (k) JOIN chosen USING (k)
"""
