"""A vector index within scopes: coarse centroids, and the rest of each vector as codes of a product quantizer.

Centroids and code words are fitted on a bounded sample, the first SAMPLE vectors by hash; every vector is indexed. Rows
are clustered by scope and list. What the codes leave of a vector is kept in one byte per dimension, with how far the
vector is from what all of that says: since queries have length 1, that distance bounds the error of a score. A search
deals the queries of each scope into sets and its rows into stripes, and streams a stripe past a set, so a task holds one
set, a batch of rows and the best so far. It passes on the best of each stripe; the vectors of the best of these alone
are read and scored exactly. Taking the lists nearest to a query is approximate, and goes by the codes; ``exact`` takes
all rows of the scope with their bytes, and reads the vectors of those whose bound reaches the k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.operators import retrieval
from corvia.operators.ranking import top_per
from corvia.tables import durable

#: Vectors that centroids and code words are fitted on, rounds of fitting, lists at most, and dimensions of a code.
SAMPLE, ROUNDS, MOST_LISTS, PER_CODE = 16384, 12, 4096, 4
#: Lists that a query reads, and candidates of its best that are scored exactly, for each of the k.
PROBES, CANDIDATES = 8, 10
#: Queries on which the number of lists is tuned.
TUNING = 100
#: What bounds in single precision may be off by.
SLACK = 1e-5
#: Queries of a set; rows of a stripe, and stripes of a scope at most (they grow beyond that number).
SET, STRIPE, STRIPES = 8192, 16384, 256
#: Queries and rows that are multiplied at a time; results that a task holds before it hands them on.
ASKED, MET, HELD = 512, 4096, 1 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The number of the nearest center of each row."""
    return np.argmin((centers**2).sum(axis=1) - 2 * (rows @ centers.T), axis=1)


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centers; those that lose all their rows are put where the worst served row is."""
    centers = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(rows, centers)
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=k)
        np.add.at(sums, own, rows)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if len(empty := np.flatnonzero(counts == 0)):
            far = np.argsort(-((rows - centers[own]) ** 2).sum(axis=1), kind="stable")[: len(empty)]
            centers[empty[: len(far)]] = rows[far]
    return centers


class Codebook:
    """Centroids (lists, dim) and code words (codes, words, PER_CODE); vectors are filled up to whole codes with zeros."""

    def __init__(self, dim: int, centroids: np.ndarray, words: np.ndarray):
        self.dim, self.centroids, self.words = dim, centroids.astype(np.float32), words.astype(np.float32)

    @staticmethod
    def fit(rows: np.ndarray, lists: int) -> Codebook:
        dim = rows.shape[1]
        rows = np.pad(rows, ((0, 0), (0, -dim % PER_CODE)))
        centroids = k_means(rows, max(1, min(lists, len(rows))))
        rest = rows - centroids[nearest(rows, centroids)]
        k = min(256, len(rows))
        words = [k_means(rest[:, i : i + PER_CODE], k) for i in range(0, rows.shape[1], PER_CODE)]
        return Codebook(dim, centroids, np.stack(words))

    def padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.centroids.shape[1] - rows.shape[1]))).astype(np.float32)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the distance between a vector and what they say, for rows of length 1."""
        rows = self.padded(rows)
        lists = nearest(rows, self.centroids)
        rest = rows - self.centroids[lists]
        codes = np.stack([nearest(rest[:, i * PER_CODE : (i + 1) * PER_CODE], w) for i, w in enumerate(self.words)], axis=1).astype(np.uint8)
        return lists, codes, np.linalg.norm(rows - self.said(lists, codes), axis=1)

    def refine(self, rows: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What list and codes leave of a vector, in bytes, their step, and the distance that is left then."""
        rest = self.padded(rows) - self.said(lists, codes)
        step = np.abs(rest).max(axis=1) / np.float32(127)
        fine = np.rint(rest / np.where(step > 0, step, 1)[:, None]).astype(np.int8)
        return fine, step, np.linalg.norm(rest - fine * step[:, None], axis=1)

    def said(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        return self.centroids[lists] + np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with centroids, and with every code word."""
        q = self.padded(queries)
        parts = q.reshape(len(q), len(self.words), PER_CODE)
        return q @ self.centroids.T, np.einsum("qcp,cwp->qcw", parts, self.words)



class Scan:
    """A set of queries that rows of their scope stream past: the best of each query, and what may be among them.

    A query reads its nearest lists from place ``first`` up to ``last``. Each row has a bound from both sides: k rows
    with lower bounds from a value on leave out those whose upper bound is below it.
    """

    def __init__(self, key: tuple, book: Codebook, k: int, exact: bool):
        self.key, self.book, self.k, self.exact = key, book, k, exact
        self.asked, self.found, self.n = [], [], 0
        self.q: np.ndarray | None = None

    def ask(self, part: pa.RecordBatch) -> None:
        self.asked.append((part["q"].to_numpy(), self.book.padded(unit(_matrix(part["v"], self.book.dim))), part["first"].to_numpy(), part["last"].to_numpy()))

    def _start(self) -> None:
        self.names, self.q, first, last = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        self.best = np.full((len(self.q), self.k), -np.inf, np.float32)  # column 0 is the k-th best
        if not self.exact:
            self.reads = np.zeros((len(self.q), len(self.book.centroids)), bool)
            for at in range(0, len(self.q), ASKED):
                some = slice(at, at + ASKED)
                order = np.argsort(-(self.q[some] @ self.book.centroids.T), axis=1, kind="stable")
                places = np.arange(order.shape[1])
                np.put_along_axis(self.reads[some], order, (places >= first[some, None]) & (places < last[some, None]), axis=1)

    def meet(self, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not self.asked:  # all queries of the scope are in other sets
            return
        if self.q is None:
            self._start()
        ids, lists = part["id"], part["list"].to_numpy()
        rows = self.book.said(lists, _bytes(part["code"], np.uint8))
        if self.exact:
            rows += _bytes(part["fine"], np.int8)[:, : rows.shape[1]] * part["step"].to_numpy()[:, None]
            error = part["error"].to_numpy() + np.float32(SLACK + rows.shape[1] * 2.0**-23)
            for lo in range(0, len(rows), MET):
                some = slice(lo, lo + MET)
                for at in range(0, len(self.q), ASKED):
                    self._meet(np.arange(at, min(at + ASKED, len(self.q))), ids[some], self.q[at : at + ASKED] @ rows[some].T, error[some])
        else:
            order = np.argsort(lists, kind="stable")
            edges = [0, *(np.flatnonzero(np.diff(lists[order])) + 1).tolist(), len(order)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                asking = np.flatnonzero(self.reads[:, lists[order[lo]]])
                for some in (order[i : min(i + MET, hi)] for i in range(lo, hi, MET)):
                    for at in range(0, len(asking), ASKED):
                        which = asking[at : at + ASKED]
                        self._meet(which, ids.take(pa.array(some)), self.q[which] @ rows[some].T, np.float32(0))
        if self.n > HELD:
            self._narrow()
            if self.n > HELD // 2:
                yield from self.finish()

    def _meet(self, which: np.ndarray, ids: pa.Array, scores: np.ndarray, error: np.ndarray) -> None:
        low, best = scores - error, self.best[which]
        better = np.flatnonzero(low.max(axis=1) > best[:, 0])
        if len(better):
            both = np.concatenate([best[better], low[better]], axis=1)
            best[better] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            self.best[which] = best
        i, j = np.nonzero(scores + error >= best[:, :1])
        if len(i):
            wide = error[j] if np.ndim(error) else error
            self.found.append((which[i], ids.take(pa.array(j)), scores[i, j] - wide, scores[i, j] + wide))
            self.n += len(i)

    def _narrow(self) -> None:
        for at, (q, ids, low, high) in enumerate(self.found):
            left = high >= self.best[q, 0]
            self.found[at] = (q[left], ids.filter(pa.array(left)), low[left], high[left])
        self.n = sum(len(x[0]) for x in self.found)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self._narrow()
        if self.n:
            q, ids, low, high = zip(*self.found, strict=True)
            columns = [pa.array(self.names[np.concatenate(q)]), pa.concat_arrays(ids), *(pa.array(np.concatenate(x).astype(np.float64)) for x in (low, high))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "id", "low", "high"])
        self.found, self.n = [], 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _bytes(column: pa.Array, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


class VectorIndex:
    """The index of one table, below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def _usable(vectors: DataFrame, id_col: str, vector_col: str, scope: Column) -> DataFrame:
        """(scope, id, v): vectors that are null, empty or zero, or have a null or no number in them, take no part."""
        held = vectors.select(scope.cast("string").alias("scope"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return held.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def build(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scope: Column | None = None) -> VectorIndex:
        """Index all vectors of one length, each in its scope (null: one of its own)."""
        held = self._usable(vectors, id_col, vector_col, F.lit(None) if scope is None else scope)
        sample = held.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("v").collect()
        if not sample:
            raise ValueError("no vectors to index")
        rows = np.array([r["v"] for r in sample])
        book = Codebook.fit(unit(rows), min(MOST_LISTS, max(1, int(np.sqrt(held.count())))))
        flat = [(book.dim, list(book.centroids.shape), book.centroids.ravel().tolist(), list(book.words.shape), book.words.ravel().tolist())]
        self.spark.createDataFrame(flat, "dim int, c_shape array<int>, centroids array<float>, w_shape array<int>, words array<float>").coalesce(1).write.parquet(f"{self.folder}/codebook")
        kind = held.schema["id"].dataType

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    rows = unit(_matrix(batch.column(2), book.dim))
                    lists, codes, _ = book.encode(rows)
                    fine, step, error = book.refine(rows, lists, codes)
                    columns = [batch.column(0), pa.array(lists.astype(np.int32)), batch.column(1), _packed(codes), _packed(fine), pa.array(step.astype(np.float32)), pa.array(error.astype(np.float32))]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

        schema = T.StructType().add("scope", "string").add("list", T.IntegerType()).add("id", kind)
        schema = schema.add("code", "binary").add("fine", "binary").add("step", "float").add("error", "float")
        coded = held.mapInArrow(code, schema)
        order = ["scope", "list", F.xxhash64("id")]  # a large list is dealt over many files
        coded.repartitionByRange(*order).sortWithinPartitions("scope", "list").write.parquet(f"{self.folder}/codes")
        return self

    def book(self) -> Codebook:
        r = self.spark.read.parquet(f"{self.folder}/codebook").first()
        return Codebook(r["dim"], np.array(r["centroids"]).reshape(r["c_shape"]), np.array(r["words"]).reshape(r["w_shape"]))

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(q, query_id, scope, v), a written table: the queries with a number each."""
        usable = self._usable(queries.withColumnRenamed("query_id", "id"), "id", "vector", F.col("scope")).withColumnRenamed("id", "query_id")
        return durable(usable.withColumn("q", F.monotonically_increasing_id()))

    def _met(self, asked: DataFrame, k: int, exact: bool) -> DataFrame:
        """(q, id, low, high): for each query (q, scope, v, first, last) the rows that may be among its best k of a stripe,
        by their codes alone or, if exact, with their bytes."""
        key = F.concat(F.when(F.col("scope").isNull(), "0").otherwise("1"), F.coalesce("scope", F.lit(""))).alias("s")
        asked, codes = asked.select(key, "*").drop("scope"), self.spark.read.parquet(f"{self.folder}/codes").select(key, "*").drop("scope")
        n = lambda df, size: df.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n"))
        dealt = n(codes, STRIPE).select("s", F.least("n", F.lit(STRIPES)).alias("stripes")).join(n(asked, SET).select("s", F.col("n").alias("sets")), "s")
        dealt = durable(dealt)
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        names = ["s", "part", "stripe"]
        questions = asked.join(dealt, "s").select("s", deal("q", "sets").alias("part"), each("stripes").alias("stripe"), F.lit(0).alias("kind"), "q", "v", "first", "last")
        held = ["id", "list", "code", *(["fine", "step", "error"] if exact else [])]
        rows = codes.join(dealt, "s").select("s", each("sets").alias("part"), deal("id", "stripes").alias("stripe"), F.lit(1).alias("kind"), *held)
        both = questions.unionByName(rows, allowMissingColumns=True).repartition(*names).sortWithinPartitions(*names, "kind")
        book = self.book()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                marks = list(zip(*(batch[c].to_pylist() for c in (*names, "kind")), strict=True))
                edges = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if lo == hi:
                        continue
                    if state is None or state.key != marks[lo][:3]:
                        if state:
                            yield from state.finish()
                        state = Scan(marks[lo][:3], book, k, exact)
                    part = batch.slice(lo, hi - lo)
                    if marks[lo][3]:
                        yield from state.meet(part)
                    else:
                        state.ask(part)
            if state:
                yield from state.finish()

        return both.mapInArrow(scan, f"q long, id {codes.schema['id'].dataType.simpleString()}, low double, high double")

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank): the k best vectors by cosine within the scope of each query (query_id, scope, vector).

        ``vectors`` is the indexed table, of which only candidates' vectors are read.
        """
        asked = self._asked(queries)
        if exact:
            met = self._met(asked.select("q", "scope", "v", F.lit(0).alias("first"), F.lit(0).alias("last")), max(1, k), True)
            all_of = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            pairs = met.withColumn("least", F.nth_value("low", max(1, k)).over(all_of)).where("least IS NULL OR high >= least")
        else:
            pairs = self._candidates(asked.select("q", "scope", "v", F.lit(0).alias("first"), F.lit(probes).alias("last")), k)
        pairs = durable(pairs.select("q", "id").distinct())
        held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        both = pairs.join(held, "id").join(asked.select("q", "query_id", F.col("v").alias("a")), "q")
        return top_per(both.select("query_id", "id", retrieval.cosine(F.col("a"), F.col("v")).alias("score")), ["query_id"], k, [F.desc(F.round("score", 9)), F.col("id")])

    def _candidates(self, asked: DataFrame, k: int) -> DataFrame:
        """The rows with the largest scores by their codes for each query, CANDIDATES for each of the k."""
        most = max(1, k * CANDIDATES)
        return top_per(self._met(asked, most, False), ["q"], most, [F.desc("low"), F.col("id")])

    def tuned(self, vectors: DataFrame, k: int, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", scope: Column | None = None) -> int:
        """The fewest lists (doubled from 1 on) at which the first TUNING vectors by hash, taken as queries, find their share
        of what an exact search finds.

        All numbers are tried in one scan: a query asks once for each doubling, for the lists that it adds. What is
        wanted and is a candidate is found, as candidates are scored exactly.
        """
        own = self._usable(vectors, id_col, vector_col, F.lit(None) if scope is None else scope)
        sample = durable(own.orderBy(F.xxhash64("id"), "id").limit(TUNING).select(F.col("id").alias("query_id"), "scope", F.col("v").alias("vector")))
        wanted = durable(self.search(vectors, sample, k, id_col, vector_col, exact=True).select("query_id", "id"))
        lists, total = len(self.book().centroids), wanted.count()
        tries = [1 << i for i in range(lists.bit_length()) if 1 << i < lists]
        if not tries or not total:
            return 1
        most, n = k * CANDIDATES, len(tries)
        asked = self._asked(sample)
        steps = self.spark.createDataFrame([(i, tries[i - 1] if i else 0, p) for i, p in enumerate(tries)], "step int, first int, last int")
        asking = durable(asked.crossJoin(F.broadcast(steps)).select((F.col("q") * n + F.col("step")).alias("q"), F.col("q").alias("of"), "query_id", "scope", "v", "step", "first", "last"))
        met = self._candidates(asking.select("q", "scope", "v", "first", "last"), k).join(asking.select("q", "of", "query_id", "step"), "q")
        tried = met.select("of", "query_id", "id", "low", F.explode(F.sequence("step", F.lit(n - 1))).alias("step"))
        found = top_per(tried, ["of", "step"], most, [F.desc("low"), F.col("id")]).select("step", "query_id", "id").distinct()
        hits = {r["step"]: r["n"] for r in found.join(wanted, ["query_id", "id"]).groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}
        return next((p for i, p in enumerate(tries) if hits.get(i, 0) / total >= target), lists)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of the wanted rows (query_id, id) that were found."""
    row = wanted.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
