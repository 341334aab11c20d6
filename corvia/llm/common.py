"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from corvia.tables import durable, new_folder, remove  # noqa: F401 (operators and the pipeline take them from here)

#: Texts that a Python worker turns into objects at once.
ROWS = 512

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def release() -> None:
    """Give freed memory back to the system: Python workers stay around between tasks, next to those of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_process(kind: str, key, make):
    """make(key), made once in a Python process: workers serve many tasks, and loading a model costs them time."""
    held = sys.modules.setdefault("_corvia_in_process", types.ModuleType("_corvia_in_process")).__dict__
    if (kind, key) not in held:
        held[kind, key] = make(key)
    return held[kind, key]


def per_text(df: DataFrame, keep: list[str], value: Column, fields: list[tuple[str, pa.DataType]], of) -> DataFrame:
    """keep and further columns from one text column, a batch at a time.

    of() is called in each task and gives a function from a list of texts to (places, columns): which text each row of
    the result comes from (None: one row each, in order) and the columns in the order of fields (name, Arrow type).
    Kept columns go through as they are, so keys with nulls stay exact. The function's attribute ``done``, if there is
    one, is called at the end of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = of()
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                places, columns = work(batch.column(len(keep)).to_pylist())
                kept = [batch.column(i) for i in range(len(keep))]
                if places is not None:
                    at = pa.array(places, pa.int64())
                    kept = [k.take(at) for k in kept]
                made = [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *(n for n, _ in fields)])
        if done := getattr(work, "done", None):
            done()
        del work
        release()

    schema = T.StructType([df.schema[c] for c in keep])
    for name, kind in fields:
        schema = schema.add(name, from_arrow_type(kind))
    return df.select(*keep, value.alias("_value")).mapInArrow(run, schema)


def through_texts(df: DataFrame, text_col: str, of) -> DataFrame:
    """The rows of df after a function of their texts, some at a time; all columns go through as they are.

    of() is called in each task and gives a function from a list of texts to (kept, texts): a flag for each row, or None
    to keep all, and the new texts, or None to leave them.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = of()
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.slice(start, ROWS)
                kept, texts = work(batch.column(at).to_pylist())
                if texts is not None:
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield batch if kept is None else batch.filter(pa.array(kept, pa.bool_()))
        del work
        release()

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may have dots in them
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def quoted(name: str) -> Column:
    """A column by its name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: a lambda variable, never inlined into an inner loop."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """All words of the text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the source does by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def spread(*cols: Column, n: int) -> Column:
    """A stable salt from 0 to n - 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def ranked(df: DataFrame, within: list[str], block: list[str], order: list[Column], name: str = "rank0") -> DataFrame:
    """Add a gapless rank from 0 within ``within``, in the order of ``block`` and then of ``order``.

    A hot group is numbered by many tasks: rows are counted per block (a bounded number per group, with map-side
    sums), the counts are summed up over the blocks, and rows are numbered within their block only. ``within`` and
    ``block`` must not be null. ``df`` is read twice: give it cheap or checkpointed.
    """
    keys = within + block
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_before"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return inside.join(offsets, keys).withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_before", "_inside")


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``_part``, the number of the range of the order that they are in; a written table.

    Ranges are cut by a sample, but what is summed up over them in order doesn't depend on where.
    """
    return durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def sums_before(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of the values of all rows before in the order (which has no ties).

    Rows are summed up within ranges, and the ranges' sums, one row each, in one place.
    """
    rows = in_ranges(df, order)
    per = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in values.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_part", *[F.coalesce(F.sum(f"_s_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumns({f"_i_{n}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(per, "_part")
    found = found.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in values})
    return found.drop("_part", *[f"_{x}_{n}" for n in values for x in "bi"])


def sample_texts(rows: DataFrame, sample: int, chars: int) -> dict[str, list[str]]:
    """For each value of ``by``, at most ``sample`` distinct texts of rows (by, text; without nulls), the first by hash.

    Of a longer text its hash picks the stretch of ``chars`` characters. Copies count once: distinct hashes are counted
    first, rows under a limit by hash are met once per task, and the driver takes what is left of at most twice the
    sample (and a margin) for each value.
    """
    hashed = rows.select("by", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"), "text")
    counts = hashed.select("by", "h").distinct().groupBy("by").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return {}
    most, wide = (1 << 63) - 1, 2 * sample + 64
    limits = rows.sparkSession.createDataFrame([(r["by"], most if r["n"] <= wide else wide * most // r["n"]) for r in counts], "by string, most long")
    stretch = F.substring("text", F.pmod(F.col("h"), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1, F.lit(chars))
    near = hashed.join(F.broadcast(limits), "by").where("h <= most").select("by", "h", stretch.alias("text"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            fresh = [i for i, key in enumerate(zip(batch["by"].to_pylist(), batch["h"].to_pylist(), strict=True)) if key not in seen and not seen.add(key)]
            yield batch.take(pa.array(fresh, pa.int64()))

    found: dict[str, dict[int, str]] = {r["by"]: {} for r in counts}
    for r in near.mapInArrow(once, near.schema).groupBy("by", "h").agg(F.min("text").alias("text")).collect():
        found[r["by"]][r["h"]] = r["text"]
    return {by: [texts[h] for h in sorted(texts)[:sample]] for by, texts in found.items()}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
