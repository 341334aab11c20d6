"""Quality rules: fixed limits, then robust multivariate outliers, in DataFrame operations only.

Each document's statistics are transformed to near-normal scales and rounded to integers of 1/``STEP``. For every
language and source the minimum covariance determinant gives a location and a scatter that outliers can't pull:
concentration steps, each of which takes the mean and the covariance of the half of the documents nearest to the last
estimate, from two starts (median and median deviation, and all documents), the smaller determinant wins. A document
is rejected if its squared Mahalanobis distance, scaled so that the group's median is that of chi-squared, is one that
chi-squared exceeds with probability ``TAIL``: of the 2e10 documents of 100 TB less than one clean one would go.

One step is one aggregation: distances are put in bins of 1/16 of a power of two, and counts, sums and products are
added up per bin; the bins of a group (a bounded number) are summed up in order to the one that holds the half. Sums
are of integers, so results don't depend on the order of rows. Groups are never gathered in a task, and the number of
rows per (language, source, vector) is added up first. Estimates have one row per group; they are broadcast up to
``FEW_GROUPS`` groups and joined by shuffle beyond that.

A group of under ``LEAST`` documents that pass the limits is judged by its language's estimate, or else by that of all
documents; under as many in all, whatever passes the limits is kept. A
statistic that hardly varies in a group (copies may be most of it) counts as if it had the standard deviation in
``FLOORS``, and distances are never scaled up.

Defined results: null texts have no words and fail the limits; null languages and sources are values of their own;
repeated rows are judged alike; ties at the limit of the half are all taken; other columns are carried along under any
name, those named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import SPACE, durable, let, quoted, source_key, words_of

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VECTOR = ["x0", "x1", "x2", "x3"]
STEP = 64
STEPS = 4
LEAST = 100
RESULTS = [*STATS, "base_failed", "distance", "kept"]
FLOORS = (0.30, 0.12, 0.08, 0.10)
#: Probability of a distance over the cutoff in a clean group; the larger, the more documents go.
TAIL = 1e-11
#: Median of chi-squared with as many degrees of freedom as the vector has entries.
CHI_MEDIAN = 3.357
FEW_GROUPS = 20_000
#: In place of a key, for a group of all its values; keys begin with 0 or 1.
ALL = "*"


def cutoff_of(tail: float) -> float:
    """The value that chi-squared with 4 degrees of freedom exceeds with probability ``tail``: exp(-x/2) (1 + x/2) = tail."""
    x = 0.0
    for _ in range(200):  # a fixed point of x/2 = log(1 + x/2) - log(tail)
        x = 2 * (math.log1p(x / 2) - math.log(tail))
    return x


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the list.

    A window's hash and its position share a long (as many low bits as positions need), so one sort of longs brings
    equal hashes together. Windows of equal hashes that stand next to each other are compared word by word: if all are
    equal, the hashes are right for this text; else its windows are sorted as strings, in the same way.
    """
    one = lambda n: F.lit(n).cast("long")

    def of(w: Column) -> Column:
        return F.when(F.size(w) < 4, one(0)).otherwise(let(F.struct(w.alias("w"), (F.length(F.bin(F.size(w)))).alias("b")), hashed))

    def hashed(s: Column) -> Column:
        w, bits = s["w"], s["b"]
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long")))
        return let(F.struct(F.array_sort(keys).alias("k"), bits.alias("b"), w.alias("w")), grouped)

    def grouped(s: Column) -> Column:
        k, bits = s["k"], s["b"]
        top = lambda x: F.call_function("shiftrightunsigned", x, bits)
        place = lambda x: x.bitwiseAND(F.call_function("shiftleft", one(1), bits) - 1)
        same = F.filter(k, lambda x, i: (top(x) == top(F.get(k, i - 1))) | (top(x) == top(F.get(k, i + 1))) | F.lit(False))
        return let(F.struct(F.transform(same, lambda x: F.struct(top(x).alias("h"), place(x).cast("int").alias("p"))).alias("s"), s["w"].alias("w")), checked)

    def checked(s: Column) -> Column:
        found, w = s["s"], s["w"]
        differ = lambda a, b: (F.get(w, a) != F.get(w, b)) | (F.get(w, a + 1) != F.get(w, b + 1)) | (F.get(w, a + 2) != F.get(w, b + 2))
        wrong = F.exists(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda i: F.coalesce((F.get(found, i)["h"] == F.get(found, i - 1)["h"]) & differ(F.get(found, i)["p"], F.get(found, i - 1)["p"]), F.lit(False)))
        return F.when(wrong, let(w, exact)).otherwise(covered(F.transform(found, lambda x: x["p"].cast("long"))))

    def exact(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, F.lit(3))).alias("t"), i.cast("long").alias("p")))
        return let(F.array_sort(keys), lambda k: covered(F.transform(F.filter(k, lambda x, i: (x["t"] == F.get(k, i - 1)["t"]) | (x["t"] == F.get(k, i + 1)["t"]) | F.lit(False)), lambda x: x["p"])))

    def covered(places: Column) -> Column:
        start = F.struct(one(0).alias("n"), one(-3).alias("last"))
        return F.aggregate(F.array_sort(places), start, lambda a, x: F.struct((a["n"] + F.least(one(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])

    return let(words, of).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five statistics of the whole text, in place of columns of their names; other columns as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    others = F.struct(*[quoted(c) for c in docs.columns if c not in STATS]).alias("_doc")
    chars = F.length(F.regexp_replace(text, SPACE, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")
    repeated = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    found = docs.select(others, both.alias("_w"), chars.alias("word_chars"), symbols.alias("n_symbols"), repeated.alias("n_dup_lines"))
    return found.select("_doc.*", F.col("_w.n").alias("n_words"), F.col("_w.r").alias("n_repeat_words"), "word_chars", "n_symbols", "n_dup_lines")


def vector() -> list[Column]:
    """Transformed statistics: length, mean word length, and the shares of symbols and of repeated lines and words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = [F.log1p(n) / 2, F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n) * 4, F.log1p(20 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))), 0.9 * F.log1p((2 * F.col("n_repeat_words") + F.col("n_dup_lines")) / n)]
    return [F.round(v * STEP).cast("long") for v in values]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def moments(weight: Column) -> list[Column]:
    """Exact sums of weights, entries and products of entries."""
    wide = lambda c: c.cast("decimal(38,0)")
    sums = [F.sum(wide(weight)).alias("n")]
    sums += [F.sum(wide(weight * F.col(x))).alias(f"s_{x}") for x in VECTOR]
    return sums + [F.sum(wide(weight * F.col(x) * F.col(y))).alias(f"p_{x}_{y}") for i, x in enumerate(VECTOR) for y in VECTOR[: i + 1]]


def moment_names() -> list[str]:
    return ["n", *(f"s_{x}" for x in VECTOR), *(f"p_{x}_{y}" for i, x in enumerate(VECTOR) for y in VECTOR[: i + 1])]


def estimate(sums: DataFrame, keep: list[str]) -> DataFrame:
    """Mean m_*, and the Cholesky factor l_* of the covariance (with the floors squared added to variances), from moments."""
    n = F.col("n").cast("double")
    found = sums.select(*keep, "n", *[(F.col(f"s_{x}").cast("double") / n).alias(f"m_{x}") for x in VECTOR], *[F.col(f"p_{x}_{y}") for i, x in enumerate(VECTOR) for y in VECTOR[: i + 1]])
    floor = [(f * STEP) ** 2 for f in FLOORS]
    cov = {(i, j): F.col(f"p_{x}_{y}").cast("double") / n - F.col(f"m_{x}") * F.col(f"m_{y}") + (floor[i] if i == j else 0.0) for i, x in enumerate(VECTOR) for j, y in enumerate(VECTOR[: i + 1])}
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            less = cov[i, j]
            for k in range(j):
                less = less - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            found = found.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(less, F.lit(floor[i] / 4))) if i == j else less / F.col(f"l_{j}_{j}"))
    return found.drop(*[f"p_{x}_{y}" for i, x in enumerate(VECTOR) for y in VECTOR[: i + 1]])


def distance2(df: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i, x in enumerate(VECTOR):
        value = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            value = value - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        df = df.withColumn(f"z_{i}", value / F.col(f"l_{i}_{i}"))
    return df.withColumn(name, sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(VECTOR))), F.col("z_0") * F.col("z_0"))).drop(*[f"z_{i}" for i in range(len(VECTOR))])


ESTIMATE = [f"m_{x}" for x in VECTOR] + [f"l_{i}_{j}" for i in range(len(VECTOR)) for j in range(i + 1)]


def bin_of(d2: Column) -> Column:
    return F.greatest(F.floor(F.log2(F.greatest(d2, F.lit(1e-6))) * 16), F.lit(-160)).cast("int")


def robust(vectors: DataFrame, keys: list[str], steps: int = STEPS) -> tuple[DataFrame, bool]:
    """(keys, estimate, scale) for each group of vectors (keys, VECTOR), and whether there are few groups.

    keys must not be null. Groups under the leading keys alone, and under none, are estimated too; a group of under
    LEAST vectors gets the estimate of the next wider one that has as many, or none.
    """
    cells = vectors.groupBy(*keys, *VECTOR).agg(F.count(F.lit(1)).alias("w"))
    pooled = [F.struct(*[(F.col(k) if i < n else F.lit(ALL)).alias(k) for i, k in enumerate(keys)]) for n in range(len(keys), -1, -1)]
    cells = cells.select(F.explode(F.array(*pooled)).alias("_g"), *VECTOR, "w").select("_g.*", *VECTOR, "w")
    cells = durable(cells.groupBy(*keys, *VECTOR).agg(F.sum("w").alias("w")))
    sizes = durable(cells.groupBy(*keys).agg(F.sum("w").alias("size"), *[F.percentile(x, F.lit(0.5), F.col("w")).alias(f"c_{x}") for x in VECTOR]).where(F.col("size") >= LEAST))
    few = sizes.count() <= FEW_GROUPS
    hint = F.broadcast if few else lambda df: df
    cells = cells.join(hint(sizes), keys)
    spreads = cells.groupBy(*keys).agg(*[F.percentile(F.abs(F.col(x) - F.col(f"c_{x}")), F.lit(0.5), F.col("w")).alias(f"a_{x}") for x in VECTOR])
    middle = sizes.join(spreads, keys).select(*keys, F.lit(0).alias("start"), *[F.col(f"c_{x}").cast("double").alias(f"m_{x}") for x in VECTOR], *[(F.greatest(1.4826 * F.col(f"a_{VECTOR[i]}"), F.lit(FLOORS[i] * STEP)) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(len(VECTOR)) for j in range(i + 1)])
    everyone = estimate(cells.groupBy(*keys).agg(*moments(F.col("w"))), keys).select(*keys, F.lit(1).alias("start"), *ESTIMATE)
    now = durable(middle.union(everyone))
    for _ in range(steps):
        now = durable(concentrate(cells, now, keys, hint))
    spread2 = distance2(cells.select(*keys, *VECTOR, "w", "size").join(hint(now), keys))
    bins = spread2.groupBy(*keys, "start", bin_of(F.col("d2")).alias("bin")).agg(F.sum("w").alias("w"), F.first("size").alias("size"))
    up_to = Window.partitionBy(*keys, "start").orderBy("bin")
    half = bins.withColumn("upto", F.sum("w").over(up_to)).where("2 * upto >= size").groupBy(*keys, "start").agg(F.min("bin").alias("bin"))
    volume = sum((F.log(F.col(f"l_{i}_{i}")) for i in range(1, len(VECTOR))), F.log(F.col("l_0_0")))
    best = now.join(half, [*keys, "start"]).withColumn("scale", F.least(F.lit(1.0), F.lit(CHI_MEDIAN) / F.pow(F.lit(2.0), (F.col("bin") + 1) / 16)))
    best = best.withColumn("volume", F.round(volume - len(VECTOR) / 2 * F.log("scale"), 9))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("volume", "start"))
    best = durable(best.withColumn("_r", first).where("_r = 1").select(*keys, F.struct(*ESTIMATE, "scale").alias("e")))
    found = vectors.select(*keys).distinct()
    for n in range(len(keys), -1, -1):
        wider = best.where(F.col(keys[n]) == ALL) if n < len(keys) else best
        wider = (wider.where(F.col(keys[n - 1]) != ALL) if n else wider).select(*keys[:n], F.col("e").alias(f"e_{n}"))
        if n:
            found = found.join(hint(wider), keys[:n], "left")
        else:  # one row
            one = wider.first()
            found = found.withColumn("e_0", F.struct(*[F.lit(one["e_0"][c] if one else None).cast("double").alias(c) for c in [*ESTIMATE, "scale"]]))
    held = F.coalesce(*[F.col(f"e_{n}") for n in range(len(keys), -1, -1)])
    return durable(found.select(*keys, held.alias("e")).select(*keys, "e.*").where(F.col("scale").isNotNull())), few


def concentrate(cells: DataFrame, now: DataFrame, keys: list[str], hint) -> DataFrame:
    """One concentration step for every group and start."""
    at = distance2(cells.select(*keys, *VECTOR, "w", "size").join(hint(now), keys))
    bins = at.groupBy(*keys, "start", bin_of(F.col("d2")).alias("bin")).agg(F.first("size").alias("size"), *moments(F.col("w")))
    up_to = Window.partitionBy(*keys, "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = bins.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).where("2 * before < size")
    near = near.groupBy(*keys, "start").agg(*[F.sum(c).alias(c) for c in moment_names()])
    return estimate(near, [*keys, "start"]).select(*keys, "start", *ESTIMATE)


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Every row of docs with the statistics, base_failed, distance (null where no group speaks) and kept."""
    found = docs if set(STATS) <= set(docs.columns) else with_statistics(docs)
    carried = [c for c in found.columns if c not in RESULTS]  # in a struct, where no name clashes with those of an estimate
    found = found.select(F.struct(*[quoted(c) for c in carried]).alias("_row"), *STATS, source_key(F.col("lang")).alias("_lang"), source_key(F.col("source")).alias("_source"))
    found = found.withColumn("base_failed", base_failed()).withColumns(dict(zip(VECTOR, vector(), strict=True)))
    keys = ["_lang", "_source"]
    groups, few = robust(found.where(~F.col("base_failed")).select(*keys, *VECTOR), keys)
    judged = distance2(found.join(F.broadcast(groups) if few else groups, keys, "left"))
    judged = judged.withColumn("distance", F.col("d2") * F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff_of(tail))
    return judged.select("_row.*", *STATS, "base_failed", "distance", kept.alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    rows = durable(with_statistics(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", *STATS))
    return judge(rows).select("doc_id", *STATS, "base_failed", "kept", F.round("distance", 6).alias("distance"))
