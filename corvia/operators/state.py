"""Tables with a key: upserts, partial and optimistic updates, soft and hard deletes, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A table, or a row that has to be there, is missing."""


def fetch(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return table.where(F.col(key) == value).limit(1)


def fetch_many(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of the keys; unknown ones are passed over."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def upsert(stored: DataFrame, rows: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Stored rows, with the last new row of each key in their place."""
    if order is not None:
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")
    return stored.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*stored.columns)


def split_valid(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without a problem, those with one (problem), and the counts ok and fail."""
    judged = rows.withColumn("problem", problem)
    counts = judged.agg(F.count_if(F.col("problem").isNull()).alias("ok"), F.count_if(F.col("problem").isNotNull()).alias("fail"))
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null"), counts


def insert_absent(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Every row with status inserted or duplicate: the first of a key that is not stored goes in."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c) for c in rows.columns if c not in key] or [F.lit(1)]))
    known = stored.select(*key).distinct().withColumn("_known", F.lit(True))
    judged = rows.withColumn("_n", first).join(known, key, "left")
    return judged.withColumn("status", F.when(F.col("_known").isNull() & (F.col("_n") == 1), "inserted").otherwise("duplicate")).drop("_n", "_known")


def insert_unique(stored: DataFrame, rows: DataFrame, keys: list[list[str]], order: str) -> DataFrame:
    """Every row with status inserted or duplicate and the key (by its number) that it repeats, for several unique keys.

    A row goes in if none of its keys is stored and none is that of an earlier row, in ``order``, that has a stored key
    of no kind either; a key with a null part repeats none.
    """
    judged = rows.withColumn("_hit", F.lit(None).cast("int"))
    for i, key in enumerate(keys):
        known = stored.select(*key).distinct().withColumn("_k", F.lit(True))
        judged = judged.join(known, key, "left").withColumn("_hit", F.coalesce("_hit", F.when(F.col("_k"), F.lit(i)))).drop("_k")
    for i, key in enumerate(keys):
        whole = F.col(key[0]).isNotNull()
        for c in key[1:]:
            whole = whole & F.col(c).isNotNull()
        firsts = judged.where(F.col("_hit").isNull() & whole).groupBy(*key).agg(F.min(order).alias("_first"))
        judged = judged.join(firsts, key, "left").withColumn("_hit", F.coalesce("_hit", F.when(F.col(order) > F.col("_first"), F.lit(i)))).drop("_first")
    return judged.select(*rows.columns, F.when(F.col("_hit").isNull(), "inserted").otherwise("duplicate").alias("status"), F.col("_hit").alias("repeats"))


def patch(stored: DataFrame, patches: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows with the patches' columns that aren't null; columns that no patch has are kept."""
    changed = [c for c in patches.columns if c not in key]
    joined = stored.join(patches.select(*key, *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changed else F.col(c) for c in stored.columns])


def delete(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without those of the keys; unknown keys do nothing."""
    return stored.join(keys.select(*key).distinct(), key, "left_anti")


def optimistic_update(stored: DataFrame, patches: DataFrame, key: list[str], now: Column | None = None) -> DataFrame:
    """Stored rows after patches (key, expected_revision, columns), with outcome: updated, conflict or kept.

    A patch applies if the revision is the expected one: its columns that aren't null are taken (structs as a whole)
    and the revision goes up by one, even if nothing else changes.
    """
    changed = [c for c in patches.columns if c not in (*key, "expected_revision")]
    joined = stored.join(patches.select(*key, "expected_revision", *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    hit = F.coalesce(F.col("expected_revision") == F.col("revision"), F.lit(False))
    outcome = F.when(F.col("expected_revision").isNull(), "kept").when(hit, "updated").otherwise("conflict")
    columns = []
    for c in stored.columns:
        if c == "revision":
            columns.append((F.col(c) + hit.cast("int")).alias(c))
        elif c in changed:
            columns.append(F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at" and now is not None:
            columns.append(F.when(hit, now).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns, outcome.alias("outcome"))


def archive(stored: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """Soft delete at the expected revision; what is archived already is a conflict."""
    active = stored.where("lifecycle_state <> 'archived'")
    wanted = keys.select(*key, "expected_revision").withColumn("lifecycle_state", F.lit("archived"))
    done = optimistic_update(active, wanted, key)
    again = stored.where("lifecycle_state = 'archived'").join(keys.select(*key).withColumn("_a", F.lit(True)), key, "left")
    return done.unionByName(again.withColumn("outcome", F.when(F.col("_a"), "conflict").otherwise("kept")).drop("_a"))


def conditional_update(stored: DataFrame, patches: DataFrame, key: list[str], allowed: list[str]) -> DataFrame:
    """Patches with an expected_status (null: any) to allowed columns only."""
    if extra := set(patches.columns) - {*key, "expected_status", *allowed}:
        raise ValueError(f"not to be patched: {sorted(extra)}")
    changed = [c for c in patches.columns if c in allowed]
    joined = stored.join(patches.select(*key, F.lit(True).alias("_p"), "expected_status", *[F.col(c).alias(f"_{c}") for c in changed]), key, "left")
    hit = F.coalesce(F.col("_p") & (F.col("expected_status").isNull() | (F.col("expected_status") == F.col("status"))), F.lit(False))
    return joined.select(*[F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in stored.columns], F.when(F.col("_p").isNull(), "kept").when(hit, "updated").otherwise("conflict").alias("outcome"))


def reject_duplicates(rows: DataFrame, key: Column) -> DataFrame:
    """Rows whose key occurs once: all rows of a repeated key are dropped, the first as well.

    Counting goes before the join, so a hot key is one row when it is joined.
    """
    repeated = rows.groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k")
    return rows.withColumn("_k", key).join(repeated, "_k", "left_anti").drop("_k")


def duplicate_keys(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n) of repeated keys."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def counters(values: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value): the keys' values as integers, null where missing or no number."""
    return keys.join(values.select("key", F.col("value").try_cast("bigint").alias("value")), "key", "left")


def index_consistency(expected: DataFrame, indexed: DataFrame, key: str = "id") -> DataFrame:
    """(id, problem): missing from the index, or orphan in it."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("i")).union(indexed.select(key, F.lit(0), F.lit(1)))
    seen = both.groupBy(key).agg(F.max("e").alias("e"), F.max("i").alias("i")).where("e <> i")
    return seen.select(key, F.when(F.col("e") == 1, "missing").otherwise("orphan").alias("problem"))
