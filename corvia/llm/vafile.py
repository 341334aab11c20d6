"""Exact top-k inner products by a vector-approximation file.

Distinct vectors are held twice: exactly, in a table that only the last step reads, and as a file of cells, one byte
per dimension on a grid over the range of that dimension. A query first scans the cells: the centre of a vector's cells
and the cells' widths bound its inner product from both sides. What is under the k-th best lower bound goes. Of the
rest, the k of the best bounds are read exactly first; their k-th exact score decides which others can still win, and
those alone are read. Results are exact for any data; the cells decide only how much is read.

Queries are a stated set, against all rows. The scan deals queries into sets of ``QUERIES`` and cells into stripes, and
streams a stripe past a set, so a task holds one set, a batch of cells and what has survived so far, and hands on about
k candidates per query, whatever the number of vectors. Equal vectors are one in the scan: only the k + 1 smallest ids
of them can be among the best, and queries of one vector are answered together.

Defined results: vectors without an id, that are null or that hold null or non-finite components take no part;
components beyond 2^43 count as 2^43, and scores beyond a long as its ends; vectors are compared with those of their own
length only (empty ones score 0 with each other); equal scores go by vec_id; of repeated rows each is a candidate and
each query row misses only itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvia.llm.common import durable, release

K = 10
#: Queries of a set; vectors of a stripe, and stripes at most (they grow beyond that number).
QUERIES, BLOCK, STRIPES = 8192, 8192, 256
#: Cells per dimension.
CELLS = 256
#: Queries and cells that are multiplied at a time; survivors that a task holds before it hands them on.
ASKED, MET, HELD = 512, 4096, 1 << 21
#: Vectors' lengths up to which their grids are broadcast.
FEW = 1000
LARGEST = float(1 << 53)


class VaFile:
    """The grid and the cells of a block of exact integer vectors."""

    def __init__(self, exact: np.ndarray):
        low, high = exact.min(axis=0), exact.max(axis=0)
        self.width, self.low = ((high - low) // CELLS + 1).astype(np.float64), low.astype(np.float64)
        self.cells = ((exact - low) // self.width.astype(np.int64)).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and vector the middle of the score's interval; for each query half its length."""
        weights, base, reach = weighed(queries.astype(np.float64), self.low, self.width)
        return weights @ self.cells.T.astype(np.float32) + base[:, None], reach + np.abs(base) * 1e-6


def weighed(queries: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of the cells, what is added to their product, and by how much the score may lie beside the sum."""
    weights, base = queries * width, queries @ (low + (width - 1) / 2)
    rounding = np.abs(weights).sum(axis=1) * CELLS * (queries.shape[1] + 4) * 2.0**-23
    return weights.astype(np.float32), base, np.abs(queries) @ ((width - 1) / 2) + rounding + np.abs(base) * 1e-12 + 1e-6


class Scan:
    """A set of queries that cells stream past: the best k products of each query, and the cells that may be among them."""

    def __init__(self, key: tuple, k: int):
        self.key, self.k, self.asked, self.ready = key, k, [], False
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def ask(self, part: pa.RecordBatch) -> None:
        self.asked.append((part["key"].to_numpy(), _matrix(part["w"], self.key[0], np.float32), part["reach"].to_numpy()))

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.ready = True
            self.q, self.w, self.reach = (np.concatenate([x[i] for x in self.asked]) if self.asked else np.zeros((0, self.key[0]) if i == 1 else 0) for i in range(3))
            self.best = np.full((len(self.q), self.k), -np.inf, np.float32)
        keys, cells = part["key"].to_numpy(), _matrix(part["cells"], self.key[0], np.int8)
        for lo in range(0, len(keys), MET):
            some = cells[lo : lo + MET].astype(np.float32).T
            for at in range(0, len(self.q), ASKED):
                self._meet(at, keys[lo : lo + MET], self.w[at : at + ASKED] @ some)
            if self.n > HELD:
                self._narrow()
                if self.n > HELD // 2:
                    yield from self._hand_on()

    def _meet(self, at: int, keys: np.ndarray, products: np.ndarray) -> None:
        best = self.best[at : at + len(products)]
        better = np.flatnonzero(products.max(axis=1) > best[:, 0])
        if len(better):  # column 0 is the k-th best
            both = np.concatenate([best[better], products[better]], axis=1)
            best[better] = np.sort(np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :], axis=1)
        i, j = np.nonzero(products >= self._least(slice(at, at + len(products)))[:, None])
        if len(i):
            self.found.append((at + i, keys[j], products[i, j]))
            self.n += len(i)

    def _least(self, of) -> np.ndarray:
        """The smallest product that may still be among the best."""
        return np.nextafter((self.best[of][:, 0].astype(np.float64) - 2 * self.reach[of]).astype(np.float32), np.float32(-np.inf))

    def _narrow(self) -> None:
        if self.found:
            i, c, p = (np.concatenate(x) for x in zip(*self.found, strict=True))
            left = p >= self._least(i)
            self.found, self.n = [(i[left], c[left], p[left])], int(left.sum())

    def _hand_on(self) -> Iterator[pa.RecordBatch]:
        for i, c, p in self.found:
            yield pa.RecordBatch.from_arrays([pa.array(self.q[i]), pa.array(c), pa.array(p.astype(np.float64))], ["q", "c", "p"])
        self.found, self.n = [], 0

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._narrow()
        yield from self._hand_on()


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dim)


def scanned(rows: DataFrame, k: int) -> DataFrame:
    """(q, c, p): for each query the cells whose product may be among the best k of a stripe.

    rows: (dim, qs, st, kind, key, w, reach, cells) with queries as kind 0 and cells as kind 1.
    """
    names = ["dim", "qs", "st"]
    dealt = rows.repartition(*names).sortWithinPartitions(*names, "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            marks = np.stack([batch[c].to_numpy() for c in (*names, "kind")])
            cuts = np.r_[0, np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1, len(batch)]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                key = tuple(marks[:3, lo].tolist())
                if state is None or state.key != key:
                    if state:
                        yield from state.finish()
                    state = Scan(key, k)
                part = batch.slice(lo, hi - lo)
                if marks[3, lo]:
                    yield from state.meet(part)
                else:
                    state.ask(part)
        if state:
            yield from state.finish()
        del state
        release()

    return dealt.mapInArrow(scan, "q long, c long, p double")


def inner(a: Column, b: Column) -> Column:
    """The inner product of arrays of longs, exactly; beyond a long it is its end."""
    wide = lambda x: x.cast("decimal(38,0)")
    most = lambda x: F.array_max(F.transform(x, F.abs)).cast("double")
    large = most(a) * most(b) * F.size(a) > F.lit(float(1 << 62))
    exact = F.aggregate(F.zip_with(a, b, lambda x, y: wide(wide(x) * wide(y))), wide(F.lit(0)), lambda s, x: wide(s + x))
    ends = F.greatest(F.least(exact, wide(F.lit((1 << 63) - 1))), wide(F.lit(-(1 << 63)))).cast("long")
    return F.when(large, ends).otherwise(F.aggregate(F.zip_with(a, b, lambda x, y: F.when(large, F.lit(0)).otherwise(x * y)), F.lit(0).cast("long"), lambda s, x: s + x))


def grids(vectors: DataFrame) -> DataFrame:
    """(dim, grid): for each length of vectors, the low end and the width of each dimension's cells."""
    ends = vectors.select("dim", F.posexplode("e").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = F.floor((F.col("high") - F.col("low")) / CELLS) + 1
    cell = F.struct("at", F.col("low").cast("double").alias("low"), width.cast("double").alias("width"))
    return ends.groupBy("dim").agg(F.array_sort(F.collect_list(cell)).alias("grid"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, copy, rank, id, score) over vectors (id, array of numbers); copy tells repeated query rows apart."""
    ok = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    part = lambda x: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), 1024 * x))).cast("long")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(ok)
    rows = rows.select("id", F.transform("v", part).alias("e")).withColumn("h", F.xxhash64("e"))
    # distinct vectors with the ids that can be among the best
    first = F.row_number().over(Window.partitionBy("h", "e").orderBy("id"))
    held = rows.withColumn("_r", first).where(F.col("_r") <= k + 1).groupBy("h", "e").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    held = durable(held.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("e")))
    asking = rows.where(is_query.cast("boolean")).groupBy("id", "h", "e").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    asking = durable(asking.join(held.select("h", "e", "c"), ["h", "e"]).select(F.col("id").alias("query_id"), "copies", F.col("c").alias("q")))
    exact = held.select("c", "ids", "e")
    # cells and queries on the grid
    grid = durable(grids(held))
    on_grid = held.select("c", "dim", "e").join(F.broadcast(grid) if grid.count() <= FEW else grid, "dim", "left").withColumn("grid", F.coalesce("grid", F.array().cast(grid.schema["grid"].dataType)))
    cell = lambda x, g: (F.floor((x - g["low"]) / g["width"]) - CELLS // 2).cast("tinyint")
    cells = durable(on_grid.select("c", "dim", F.zip_with("e", "grid", cell).alias("cells")))
    total = lambda value: F.aggregate(F.zip_with("e", "grid", value), F.lit(0.0), lambda s, x: s + x)
    asked = on_grid.join(asking.select(F.col("q").alias("c")).distinct(), "c", "left_semi")
    base = total(lambda x, g: x * (g["low"] + (g["width"] - 1) / 2 + g["width"] * (CELLS // 2)))
    spread = total(lambda x, g: F.abs(x) * (g["width"] - 1) / 2)
    rounding = total(lambda x, g: F.abs(x) * g["width"]) * F.lit(CELLS * 2.0**-23) * (F.col("dim") + 4)
    asked = asked.withColumn("base", base).withColumn("reach", spread + rounding + F.abs("base") * 1e-12 + 1e-6)
    asked = durable(asked.select(F.col("c").alias("q"), "dim", F.zip_with("e", "grid", lambda x, g: (x * g["width"]).cast("float")).alias("w"), "base", "reach"))
    # the scan: k + 1, as one may be the query itself
    n_sets = max(1, -(-asked.count() // QUERIES))
    n_stripes = max(1, min(STRIPES, -(-cells.count() // BLOCK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    questions = asked.select("dim", deal("q", n_sets).alias("qs"), each(n_stripes).alias("st"), F.lit(0).alias("kind"), F.col("q").alias("key"), "w", "reach", F.lit(None).cast("array<tinyint>").alias("cells"))
    stripes = cells.select("dim", each(n_sets).alias("qs"), deal("c", n_stripes).alias("st"), F.lit(1).alias("kind"), F.col("c").alias("key"), F.lit(None).cast("array<float>").alias("w"), F.lit(0.0).alias("reach"), "cells")
    met = durable(scanned(questions.union(stripes), k + 1))
    by_bound = Window.partitionBy("q").orderBy(F.desc("p"), "c")
    first = durable(met.withColumn("r", F.row_number().over(by_bound)).where(F.col("r") <= k + 1))

    def read(some: DataFrame) -> DataFrame:
        """Exact scores of pairs."""
        with_query = some.join(exact.select(F.col("c").alias("q"), F.col("e").alias("a")), "q")
        return with_query.join(exact, "c").select("q", "c", "ids", inner(F.col("a"), F.col("e")).alias("score"))

    best = durable(read(first.select("q", "c")))
    # of the others those whose bounds reach the (k + 1)-th best bound, and then its exact score
    kth = first.where(F.col("r") == k + 1).select("q", F.col("p").alias("kth"))
    certain = durable(asked.select("q", "base", "reach").join(kth, "q").join(best.groupBy("q").agg(F.min("score").alias("least")), "q"))
    reaches = (F.col("p") >= F.col("kth") - 2 * F.col("reach")) & (F.col("base") + F.col("p") + F.col("reach") >= F.col("least"))
    open_ = met.join(certain, "q").where(reaches).select("q", "c").join(first.select("q", "c"), ["q", "c"], "left_anti")
    scored = best.union(read(open_)).select("q", "c", "score", F.explode("ids").alias("id"))
    by_score = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    tops = scored.withColumn("r", by_score).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "c", "score"))).alias("best"))
    answered = asking.join(tops, "q")
    own = F.transform("best", lambda x: (x["id"] == F.col("query_id")) & (x["c"] == F.col("q")))
    others = F.filter("best", lambda x, i: i + 1 != F.col("own"))
    answered = answered.withColumn("own", F.array_position(own, True)).select("query_id", "copies", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return answered.select("query_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def query(embeddings: DataFrame) -> DataFrame:
    found = top_k(embeddings, F.col("id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS e, row_number() OVER () AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
