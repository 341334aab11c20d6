"""Ranks and pages that don't gather a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_rank(df: DataFrame, block: Column, order: list[Column], within: list[str] | None = None, name: str = "rank0") -> DataFrame:
    """A gapless rank from 0 in the order of block, then of order; blocks are numbered by tasks of their own.

    Only the blocks' counts meet in one place, so there should be a bounded number of blocks.
    """
    within = within or []
    rows = df.withColumn("_block", block)
    counts = rows.groupBy(*within, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(within or [F.lit(1)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*within, "_block").orderBy(*order))
    ranked = rows.withColumn("_inside", inside).join(offsets, [*within, "_block"])
    return ranked.withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_block", "_before", "_inside")


def batches(df: DataFrame, size: int, block: Column, order: list[Column], name: str = "batch") -> DataFrame:
    """Consecutive batches of a fixed size, numbered from 0."""
    return blocked_rank(df, block, order, name="_rank").withColumn(name, F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def batch_count(n: Column, size: int) -> Column:
    return F.ceil(n / size)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; none for k <= 0. Each task keeps k rows only."""
    return df.orderBy(*order).limit(max(0, k))


def top_per(df: DataFrame, by: list[str], k: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; groups are cut to k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, rank).where(F.col(name) <= max(0, k))


def keyset_page(df: DataFrame, time: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """Rows by (time, key) descending after a cursor; one more than limit, so that more is known to follow."""
    if after is not None:
        t, i = F.lit(after[0]), F.lit(after[1])
        df = df.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(key) < i)))
    return df.orderBy(F.desc(time), F.desc(key)).limit(limit + 1)


def encode_cursor(time: Column, key: Column) -> Column:
    return F.concat_ws("|", F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), key.cast("string"))


def decode_cursor(cursor: Column, strict: bool = False) -> Column:
    """struct(time, key); a time without zone is in UTC, the session's zone. A cursor that is none has nulls, or is an
    error if strict."""
    parts = F.split(cursor, r"\|", 2)
    if strict:
        bad = F.try_to_timestamp(F.get(parts, F.lit(0))).isNull() | (F.coalesce(F.get(parts, F.lit(1)), F.lit("")) == "")
        parts = F.when(bad, F.raise_error(F.concat(F.lit("no cursor: "), F.coalesce(cursor, F.lit("null"))))).otherwise(parts)
    return F.struct(F.try_to_timestamp(F.get(parts, F.lit(0))).alias("time"), F.get(parts, F.lit(1)).alias("key"))


def first_seen(df: DataFrame, by: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")
