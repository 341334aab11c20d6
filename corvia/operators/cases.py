"""Benchmark cases: building them, grouping their documents, resuming a run, choosing documents for questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.operators.ranking import blocked_rank

GROUP = 5
#: Consecutive records that are numbered in one block.
BLOCK = 100_000
# How an output limit is raised from run to run.
LIMITS = (200, 500, 1500)


def pass_rates(problems: DataFrame, stats: DataFrame) -> DataFrame:
    """Problems with attempts, passes (negative counts are 0) and pass_rate, null without attempts."""
    zero = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    joined = problems.join(stats.select("problem_id", F.col("attempt_count").alias("_a"), F.col("pass_count").alias("_p")), "problem_id", "left")
    found = joined.withColumn("attempts", zero(F.col("_a"))).withColumn("passes", zero(F.col("_p"))).drop("_a", "_p")
    return found.withColumn("pass_rate", F.try_divide(F.col("passes").cast("double"), F.col("attempts").cast("double")))


def build_cases(problems: DataFrame, group_id: str, base_url: str) -> DataFrame:
    """Problems (contest_id, version, problem_id, title, statement) as cases with a unique id, sorted by it."""
    case = F.concat_ws("/", "version", F.lit(group_id), F.col("contest_id").cast("string"), F.col("problem_id").cast("string"))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.col("contest_id").cast("string"), F.lit("/"), F.col("problem_id").cast("string"))
    found = problems.withColumn("case_id", case).withColumn("source_url", url).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("problem_id").cast("string")))
    return found.dropDuplicates(["case_id"])


def source_document(cases: DataFrame) -> Column:
    """A case as markdown with a front matter."""
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("case_id: "), "case_id"), F.concat(F.lit("version: "), "version"), F.concat(F.lit("source_url: "), "source_url"), F.lit("---"), F.lit(""), F.concat(F.lit("# "), "title"), F.lit(""), F.coalesce("statement", F.lit("")))


def select_contests(contests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contests whose id, name or title is wanted (text, ord), whatever the case, in the order asked for; each once."""
    keys = F.array_distinct(F.transform(F.array(F.col("contest_id").cast("string"), "name", "title"), F.lower))
    each = contests.withColumn("_k", F.explode(keys)).join(wanted.select(F.lower("text").alias("_k"), "ord"), "_k")
    return each.groupBy("contest_id").agg(F.min("ord").alias("ord"), F.first("name").alias("name"), F.first("title").alias("title")).orderBy("ord", "contest_id")


def similar_groups(documents: DataFrame, size: int = GROUP) -> DataFrame:
    """(module, chunk, group_id, files, apis): documents (module, filename, apis) of a module in chunks of ``size``, two at least.

    Chunks follow the file names; groups are numbered from 1 by module and chunk. Blank modules are left out.
    """
    named = documents.withColumn("module", F.trim("module")).where("module <> ''")
    numbered = blocked_rank(named, F.substring("filename", 1, 3), [F.col("filename")], ["module"])
    chunks = numbered.withColumn("chunk", F.floor(F.col("rank0") / size)).groupBy("module", "chunk").agg(F.array_sort(F.collect_list(F.struct("filename", "apis"))).alias("d"))
    found = chunks.where(F.size("d") >= 2).select("module", "chunk", F.transform("d", lambda x: x["filename"]).alias("files"), F.array_distinct(F.flatten(F.transform("d", lambda x: x["apis"]))).alias("apis"))
    # chunks of a module are consecutive: all but perhaps the last have two files
    per = found.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    start = blocked_sum(per, "module", "n", "_b")
    return found.join(start, "module").withColumn("group_id", F.col("_b") + F.col("chunk") + 1).drop("_b")


def blocked_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the sum of the values of all smaller keys; keys are summed within blocks of their first letters."""
    blocks = rows.groupBy(F.substring(key, 1, 2).alias("_k")).agg(F.sum(value).alias("_v"))
    before = blocks.select("_k", F.coalesce(F.sum("_v").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # of bounded rows
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_k").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_k", F.substring(key, 1, 2)).withColumn("_in", inside).join(before, "_k").select(key, (F.col("_before") + F.col("_in")).alias(name))


def pending(records: DataFrame, done: DataFrame, order: str = "ord") -> DataFrame:
    """Records (question, ...) that are still to be answered, with the next output limit where an answer was cut.

    done: (question, output_length, output_limit), one row per answer. Equal questions are a multiset: each finished
    answer settles one of them. An answer as long as its limit is tried again with the next one; under the last it counts.
    """
    nxt = F.when((F.col("output_length") == F.col("output_limit")) & (F.col("output_limit") < LIMITS[-1]), F.when(F.col("output_limit") < LIMITS[1], LIMITS[1]).otherwise(LIMITS[2]))
    again = [F.count_if(F.col("_next") == n).alias(f"_a{n}") for n in LIMITS[1:]]  # counts, not lists: a question may be asked any number of times
    counts = done.withColumn("_next", nxt).groupBy("question").agg(F.count_if(F.col("_next").isNull()).alias("_finished"), *again)
    numbered = blocked_rank(records, F.floor(F.col(order).cast("long") / BLOCK), [F.col(order)], ["question"])
    left = numbered.withColumn("_n", F.col("rank0") + 1).join(counts, "question", "left").where(F.col("_n") > F.coalesce("_finished", F.lit(0)))
    place = F.col("_n") - F.coalesce("_finished", F.lit(0))
    first, second = (F.coalesce(f"_a{n}", F.lit(0)) for n in LIMITS[1:])
    limit = F.when(place <= first, LIMITS[1]).when(place <= first + second, LIMITS[2]).otherwise(LIMITS[0])
    return left.withColumn("next_limit", limit).drop("_n", "rank0", "_finished", *[f"_a{n}" for n in LIMITS[1:]])


def unexpected(records: DataFrame, done: DataFrame) -> DataFrame:
    """(question, extra): answers beyond the records of a question, which mean another input."""
    had = records.groupBy("question").agg(F.count(F.lit(1)).alias("_r"))
    return done.groupBy("question").agg(F.count(F.lit(1)).alias("_d")).join(had, "question", "left").withColumn("extra", F.col("_d") - F.coalesce("_r", F.lit(0))).where("extra > 0").select("question", "extra")


def allocate(documents: DataFrame, rounds: int, seed: int) -> DataFrame:
    """Documents in a seeded order, dealt to rounds in turn: the i-th goes to round i mod rounds, so rounds differ by one
    document at most. The order is numbered by blocks of its hash, never in one task."""
    h = F.xxhash64(F.lit(seed), "filename")
    return blocked_rank(documents, F.pmod(h, F.lit(1024)), [h, F.col("filename")]).withColumn("round", (F.col("rank0") % rounds).cast("int")).drop("rank0")


def pick_comparison(groups: DataFrame, used: DataFrame, seed: int) -> DataFrame:
    """Two or three files of the group that covers most unused files, unused ones first, then by seeded hash."""
    files = groups.select("group_id", F.explode("files").alias("filename")).join(used.select("filename").distinct().withColumn("_u", F.lit(1)), "filename", "left")
    best = files.groupBy("group_id").agg(F.count_if(F.col("_u").isNull()).alias("n")).orderBy(F.desc("n"), "group_id").limit(1)
    size = F.lit(2) + F.pmod(F.xxhash64(F.lit(seed)), F.lit(2))
    own = files.join(F.broadcast(best.select("group_id")), "group_id").withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("_u").isNotNull(), F.xxhash64(F.lit(seed), "filename"))))
    return own.where(F.col("_r") <= size).select("group_id", "filename")


def draw_mode(question: Column, seed: int, comparison: float = 0.1) -> Column:
    """comparison for a share of the questions, else single; drawn by hash."""
    share = F.pmod(F.xxhash64(F.lit(seed), question), F.lit(10_000)) / 10_000
    return F.when(share < comparison, "comparison").otherwise("single")


def pick_single(documents: DataFrame, used: DataFrame, seed: int) -> DataFrame:
    """One file, an unused one if there is any."""
    judged = documents.join(used.select("filename").distinct().withColumn("_u", F.lit(1)), "filename", "left")
    return judged.orderBy(F.col("_u").isNotNull(), F.xxhash64(F.lit(seed), "filename")).limit(1).drop("_u")


def related(documents: DataFrame, groups: DataFrame, filename: str, k: int, seed: int) -> DataFrame:
    """k other files: of the same group first, then of the same module, then any."""
    mine = documents.where(F.col("filename") == filename).select(F.col("module").alias("_m"))
    group = groups.where(F.array_contains("files", filename)).select(F.explode("files").alias("filename")).distinct().withColumn("_g", F.lit(1))
    judged = documents.where(F.col("filename") != filename).join(F.broadcast(mine)).join(F.broadcast(group), "filename", "left")
    priority = F.when(F.col("_g") == 1, 0).when(F.col("module") == F.col("_m"), 1).otherwise(2)
    return judged.orderBy(priority, F.xxhash64(F.lit(seed), "filename")).limit(k).select("filename", priority.alias("priority"))


def failure_examples(failures: DataFrame, per_reason: int, total: int) -> DataFrame:
    """Up to per_reason failures of each reason, then others, total in all."""
    rank = F.row_number().over(Window.partitionBy("reason").orderBy("url"))
    return failures.withColumn("_n", rank).orderBy(F.col("_n") > per_reason, "_n", "reason").limit(total).drop("_n")


def image_audit(images: DataFrame) -> DataFrame:
    """(measure, key, value) over checked images (url, reason; null for those that are fine)."""
    totals = images.agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("url").alias("urls"), F.count_if(F.col("reason").isNotNull()).alias("failed"))
    found = totals.select(F.explode(F.create_map(*[x for c in totals.columns for x in (F.lit(c), F.col(c))])).alias("key", "value")).select(F.lit("total").alias("measure"), "key", "value")
    return found.union(images.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason"), "reason", "n"))


def identity_missing(documents: DataFrame, fields: list[str]) -> DataFrame:
    """Documents with the names of identity fields that are blank."""
    return documents.withColumn("missing", F.array_compact(F.array(*[F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(c)) for c in fields])))


def supplement(documents: DataFrame, supplements: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Documents with blank fields filled from supplements; what is there stays."""
    joined = documents.join(supplements.select(key, *[F.col(c).alias(f"_{c}") for c in fields]), key, "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return joined.select(*[F.when(blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in documents.columns])
