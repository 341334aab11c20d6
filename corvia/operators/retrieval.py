"""Recall channels and their fusion.

Every channel returns ranked rows (query_id, id, score, rank); ``rrf`` and ``fuse_hits`` put channels together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvia.functions.text import token_id, tokens
from corvia.operators.ranking import top_per
from corvia.tables import durable

# The constant of reciprocal-rank fusion and the boosts of channels, confidence and status.
RRF_K = 60
CHANNEL_BOOST = {"exact": 0.30, "alias": 0.12, "metadata": 0.04}
CONFIDENCE_BOOST = {"high": 0.02, "medium": 0.01}
ACTIVE_BOOST = 0.01
GRAPH_WEIGHT = 0.02
#: Queries that are answered in one pass at most, which bounds what is collected and broadcast; larger sets take several.
BATCH_QUERIES = 1000
#: Distinct tokens up to which their frequencies are broadcast.
FEW_TOKENS = 200_000
#: Vectors in a block of candidates, and documents of a batch that are multiplied at once.
BLOCK, STRETCH = 8192, 512


# Names and words


def exact_names(names: DataFrame, docs: DataFrame, name_col: str = "name", id_col: str = "api_id", limit: int = 20, within: str | None = None) -> DataFrame:
    """(query_id, id, rank): documents of exactly that name, or with that id where no name is equal.

    names: (query_id, text). Texts that are no identifiers find nothing. ``within`` is a column of both sides that must
    agree too.
    """
    scope = [F.col(within).alias("_s")] if within else []
    asked = names.where(F.col("text").rlike(r"^[A-Za-z_][A-Za-z0-9_.:#]*$")).select("query_id", F.col("text").alias("_t"), *scope)
    held = lambda by: docs.select(F.col("id"), F.col(by).alias("_t"), *scope)
    on = ["_t", "_s"] if within else ["_t"]
    by_name = asked.join(held(name_col), on).select("query_id", "id")
    rest = asked.join(by_name.select("query_id").distinct(), "query_id", "left_anti")
    by_id = rest.join(held(id_col), on).select("query_id", "id")
    return top_per(by_name.union(by_id), ["query_id"], limit, [F.col("id")])


def lexical_score(query: str, title: Column, aliases: Column, summary: Column) -> Column:
    """How many of title, aliases and summary hold the query, whatever the case; 0 for a blank query."""
    wanted = query.lower().strip()
    if not wanted:
        return F.lit(0)
    values = F.concat(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")), F.array(summary))
    return F.size(F.filter(values, lambda v: F.contains(F.lower(v), F.lit(wanted))))


# Sparse vectors


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """(token, df): in how many documents each token is."""
    return docs.select(F.explode(F.array_distinct(tokens(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def term_counts(docs: DataFrame, id_col: str, text: Column, keep: list[str] | None = None) -> DataFrame:
    """(id, keep, token_id, token, tf, others): how often each token is in each row's text, one row per token id; ``others``
    has (token, tf) of further tokens of the same id, else null.

    A text's tokens are sorted and counted where the text is read; nothing is shuffled.
    """
    keep = keep or []
    found = docs.select(id_col, *keep, F.array_sort(tokens(text)).alias("_t")).where(F.size("_t") > 0)
    at = lambda name, i: F.get(F.col(name), i)  # noqa: E731 (null beyond the ends)
    found = found.withColumn("_i", F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: ~at("_t", i).eqNullSafe(at("_t", i - 1))))
    run = lambda start, k: F.struct(token_id(at("_t", start)).alias("token_id"), at("_t", start).alias("token"), (F.coalesce(at("_i", k + 1), F.size("_t")) - start).cast("long").alias("tf"))
    found = found.select(id_col, *keep, F.array_sort(F.transform("_i", run)).alias("_e"))
    same = lambda x: F.transform(F.filter("_e", lambda y: (y["token_id"] == x["token_id"]) & (y["token"] != x["token"])), lambda y: F.struct(y["token"].alias("token"), y["tf"].alias("tf")))
    others = lambda x, i: F.when(at("_e", i + 1)["token_id"] == x["token_id"], same(x))
    first = lambda x, i: ~x["token_id"].eqNullSafe(at("_e", i - 1)["token_id"])
    each = F.transform("_e", lambda x, i: F.struct(x["token_id"].alias("token_id"), x["token"].alias("token"), x["tf"].alias("tf"), others(x, i).alias("others"), first(x, i).alias("first")))
    rows = found.select(id_col, *keep, F.explode(F.filter(each, lambda x: x["first"])).alias("x"))
    return rows.select(id_col, *keep, "x.token_id", "x.token", "x.tf", "x.others")


def weighed(counts: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """``term_counts`` with ``weight`` (count * ln(1 + N / df), the largest of an id's tokens) in place of tokens and counts.

    Frequencies are put together by token id, one row each, so that one join gives a row's weight at once. They are
    broadcast behind a count; beyond it, adaptive execution can split the other side of a token that most documents have.
    """
    df = durable(df)
    known = df.groupBy(token_id(F.col("token")).alias("token_id")).agg(F.collect_list(F.struct("token", "df")).alias("_known"))
    both = counts.join(F.broadcast(known) if df.count() <= FEW_TOKENS else known, "token_id")
    n = F.lit(float(max(n_docs, 1)))
    df_of = lambda token: F.get(F.filter("_known", lambda k: k["token"] == token), 0)["df"]
    weight = lambda token, tf: tf * F.log1p(n / df_of(token))
    own = weight(F.col("token"), F.col("tf"))
    more = F.array_max(F.transform("others", lambda x: weight(x["token"], x["tf"])))
    found = both.withColumn("weight", F.when(F.col("others").isNull(), own).otherwise(F.greatest(own, more)))
    return found.where("weight IS NOT NULL").drop("token", "tf", "others", "_known")


def repeated(docs: DataFrame, id_col: str) -> DataFrame:
    """(id): ids of more than one row, null among them; a written table."""
    return durable(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col))


def sparse_vectors(docs: DataFrame, id_col: str, text: Column, df: DataFrame, n_docs: int, keep: list[str] | None = None) -> DataFrame:
    """(id, keep, token_id, weight): count * ln(1 + N / df) per token; unseen tokens go, the larger weight of an id stays.

    Counts are summed up where a document is read, and what is shuffled is one row for each of its tokens, once, for the
    frequencies. Of ids with several rows, counts are first summed up over the rows. ``keep`` are columns that depend on
    the id alone.
    """
    own = [id_col, *(keep or [])]
    docs = docs.select(*own, text.alias("_text"))
    twice = repeated(docs, id_col)
    plain, other = (docs, None) if twice.isEmpty() else apart(docs, twice, id_col)
    found = weighed(term_counts(plain, id_col, F.col("_text"), keep), df, n_docs).select(*own, "token_id", "weight")
    return found if other is None else found.unionByName(_summed_vectors(other, own, F.col("_text"), df, n_docs))


def apart(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id isn't among the ids, and those whose id is; null equals null."""
    marked = docs.join(ids.select(F.col(id_col).alias("_id")).withColumn("_in", F.lit(True)), F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return marked.where("_in IS NULL").drop("_id", "_in"), marked.where("_in").drop("_id", "_in")


def _summed_vectors(docs: DataFrame, own: list[str], text: Column, df: DataFrame, n_docs: int) -> DataFrame:
    """The vectors of ids with several rows, by sums over (id, token) and (id, token_id)."""
    counts = docs.select(*own, F.explode(tokens(text)).alias("token")).groupBy(*own, "token").agg(F.count(F.lit(1)).alias("tf"))
    counts = counts.withColumn("token_id", token_id(F.col("token"))).withColumn("others", F.lit(None).cast("array<struct<token:string,tf:bigint>>"))
    return weighed(counts, df, n_docs).groupBy(*own, "token_id").agg(F.max("weight").alias("weight"))


class Channel:
    """How a text channel scores: lexicon: token -> (row of the matrix, weight), matrix: (rows, queries), and whether a
    token counts as often as it occurs; of several tokens of a row the largest weight counts. It may be one of a scope."""

    def __init__(self, name: int, lexicon: dict, matrix: np.ndarray, names: list, counted: bool, scope=None):
        self.name, self.lexicon, self.matrix, self.names, self.counted, self.scope = name, lexicon, matrix, names, counted, scope

    def arrays(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row (-1: none) and weight of each token of a vocabulary."""
        held = [self.lexicon.get(t, (-1, 0.0)) for t in vocabulary]
        return np.array([r for r, _ in held], np.int64), np.array([w for _, w in held])

    def scores(self, doc: np.ndarray, row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """(n, queries) from the values of a batch's documents, which are in order; a stretch of documents is one product."""
        found = np.zeros((n, len(self.names)))
        for start in range(0, n, STRETCH):
            lo, hi = np.searchsorted(doc, [start, start + STRETCH])
            if lo < hi:
                dense = np.zeros((min(STRETCH, n - start), len(self.matrix)))
                order = lo + np.argsort(value[lo:hi], kind="stable")  # of several tokens of a row the largest stays
                dense[doc[order] - start, row[order]] = value[order]
                found[start : start + STRETCH] = dense @ self.matrix
        return found


#: (token, df) of a corpus and the number of its documents, where they are known (``frequencies``).
Known = tuple[DataFrame, int]


def sparse_channel(docs: DataFrame, queries: DataFrame, text_col: str, name: int = 0, known: Known | None = None) -> Channel:
    """The inner product of sparse vectors. The frequencies of all tokens are counted on the executors, or known; the
    driver takes only those whose id occurs in the queries."""
    n = docs.count() if known is None else known[1]
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("tf")).collect()
    ids = docs.sparkSession.createDataFrame(sorted({(r["token"],) for r in asked}), "token string").select(token_id(F.col("token")).alias("token_id")).distinct()
    frequencies = document_frequency(docs, F.col(text_col)) if known is None else known[0]
    near = frequencies.withColumn("token_id", token_id(F.col("token"))).join(F.broadcast(ids), "token_id", "left_semi")
    found = {r["token"]: (r["token_id"], float(np.log1p(max(n, 1) / r["df"]))) for r in near.collect()}
    return _channel(asked, found, name)


def _channel(asked: list, found: dict[str, tuple[int, float]], name: int = 0, scope=None) -> Channel:
    """The channel of queries' tokens (query_id, token, tf), with the id and the weight of each token of the documents."""
    place: dict[int, int] = {}
    weights: dict[tuple, float] = {}
    for r in asked:
        if r["token"] in found:
            tid, idf = found[r["token"]]
            key = (r["query_id"], place.setdefault(tid, len(place)))
            weights[key] = max(weights.get(key, 0.0), r["tf"] * idf)
    names = sorted({q for q, _ in weights})
    matrix, column = np.zeros((len(place), len(names))), {q: i for i, q in enumerate(names)}
    for (q, at), w in weights.items():
        matrix[at, column[q]] = w
    return Channel(name, {t: (place[tid], idf) for t, (tid, idf) in found.items() if tid in place}, matrix, names, True, scope)


def scoped_sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, scope_col: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k documents of each query's scope with the largest inner product of sparse vectors,
    whose frequencies are those of the scope. One reading answers the queries of all scopes; documents and queries both
    say their scope in ``scope_col``, and a document that is in several is there once for each."""

    def answer(some: DataFrame) -> DataFrame:
        asked = some.select(scope_col, "query_id", F.explode(tokens(F.col("text"))).alias("token")).groupBy(scope_col, "query_id", "token").agg(F.count(F.lit(1)).alias("tf")).collect()
        wanted = some.sparkSession.createDataFrame(sorted({(r[scope_col], r["token"]) for r in asked}), f"{scope_col} {dict(docs.dtypes)[scope_col]}, token string")
        wanted = wanted.select(scope_col, token_id(F.col("token")).alias("token_id")).distinct()
        own = docs.join(wanted.select(scope_col).distinct(), scope_col, "left_semi")
        df = own.select(scope_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token")).groupBy(scope_col, "token").agg(F.count(F.lit(1)).alias("df"))
        near = df.withColumn("token_id", token_id(F.col("token"))).join(F.broadcast(wanted), [scope_col, "token_id"], "left_semi").collect()
        n = {r[scope_col]: r["count"] for r in own.groupBy(scope_col).count().collect()}
        found: dict = {}
        for r in near:
            found.setdefault(r[scope_col], {})[r["token"]] = (r["token_id"], float(np.log1p(max(n[r[scope_col]], 1) / r["df"])))
        by_scope: dict = {}
        for r in asked:
            by_scope.setdefault(r[scope_col], []).append(r)
        channels = [_channel(rows, found[s], 0, s) for s, rows in by_scope.items() if s in found]
        return _scored(own, id_col, text_col, channels, some, k, scope_col).drop("channel")

    return in_passes(queries, answer)


def counted(docs: DataFrame, text_col: str) -> Known:
    return durable(document_frequency(docs, F.col(text_col))), docs.count()


def word_channel(queries: DataFrame, name: int = 0) -> Channel:
    """The number of a query's distinct tokens that a document holds."""
    asked = {r["query_id"]: r["w"] for r in queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("w")).collect()}
    names = sorted(q for q, ws in asked.items() if ws)
    lexicon = {w: (i, 1.0) for i, w in enumerate(sorted({w for q in names for w in asked[q]}))}
    matrix = np.zeros((len(lexicon), len(names)))
    for j, q in enumerate(names):
        matrix[[lexicon[w][0] for w in asked[q]], j] = 1.0
    return Channel(name, lexicon, matrix, names, False)


def in_passes(queries: DataFrame, answer) -> DataFrame:
    """answer(queries) for at most BATCH_QUERIES queries at a time, dealt by hash; the passes' rows together."""
    n = queries.count()
    if n <= BATCH_QUERIES:
        return answer(queries)
    parts = -(-2 * n // BATCH_QUERIES)  # half full on average
    found = None
    for i in range(parts):
        some = answer(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i))
        found = some if found is None else found.union(some)
    return found


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", known: Known | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k documents with the largest inner product of sparse vectors for each query
    (query_id, text).

    Documents are scored where they are read, against all queries of a pass at once, and only the best k of each task's
    batch are shuffled: documents aren't joined with queries. Frequencies are counted once, not for each pass.
    """
    known = known or counted(docs, text_col)
    return in_passes(queries, lambda some: _scored(docs, id_col, text_col, [sparse_channel(docs, some, text_col, known=known)], some, k).drop("channel"))


def word_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, score, rank): the k documents with the most distinct words of each query."""
    return in_passes(queries, lambda some: _scored(docs, id_col, text_col, [word_channel(some)], some, k).drop("channel"))


def _scored(docs: DataFrame, id_col: str, text_col: str, channels: list[Channel], queries: DataFrame, k: int, scope_col: str | None = None) -> DataFrame:
    """(query_id, channel, id, score, rank): the best k documents of each query in each channel, in one reading. With a
    scope, a document's row is scored by the channels of its own.

    Tokens that no query has are dropped before anything leaves the JVM; a task's scores of a query are at most k.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)[id_col]
    schema = f"query_id {kinds[0]}, channel int, id {kinds[1]}, score double"
    vocabulary = sorted({t for c in channels for t in c.lexicon})
    if not vocabulary:
        return docs.sparkSession.createDataFrame([], schema + ", rank int")
    shared = docs.sparkSession.sparkContext.broadcast(channels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known = pa.array(vocabulary, pa.string())
        tables: dict = {}
        for c in shared.value:
            tables.setdefault(c.scope, []).append(c)
        coded = {}  # rows and weights of channels that have been used
        for batch in batches:
            scopes = batch.column(2).to_pylist() if scope_col else [None] * len(batch)
            edges = [0, *(i for i in range(1, len(batch)) if scopes[i] != scopes[i - 1]), len(batch)] if len(batch) else [0]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own, part = tables.get(scopes[lo], ()), batch.slice(lo, hi - lo)
                if not own:
                    continue
                held: dict[int, list[tuple]] = {}
                for start in range(0, len(part), STRETCH):  # a stretch at a time: what is dense doesn't grow with the batch
                    some = part.slice(start, STRETCH)
                    lists = some.column(1)
                    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                    code = pc.index_in(pc.list_flatten(lists), known).to_numpy(zero_copy_only=False).astype(np.int64)
                    pairs, counts = np.unique(doc * len(vocabulary) + code, return_counts=True)
                    doc, code = np.divmod(pairs, len(vocabulary))
                    for n, c in enumerate(own):
                        row, weight = coded.get(id(c)) or coded.setdefault(id(c), c.arrays(vocabulary))
                        mine = row[code] >= 0
                        value = weight[code[mine]] * (counts[mine] if c.counted else 1)
                        scores = c.scores(doc[mine], row[code[mine]], value, len(some))
                        at, column = best(some.column(0), scores, k)
                        if len(at):
                            held.setdefault(n, []).append((some.column(0).take(pa.array(at)), column, scores[at, column]))
                for n, parts in held.items():
                    ids, column, values = pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                    at = first_of(ids, column, values, k) if len(parts) > 1 else np.arange(len(ids))
                    c = own[n]
                    yield pa.RecordBatch.from_arrays([pa.array([c.names[j] for j in column[at].tolist()], query_kind), pa.array(np.full(len(at), c.name, np.int32)), ids.take(pa.array(at)), pa.array(values[at])], ["query_id", "channel", "id", "score"])

    asked = F.filter(tokens(F.col(text_col)), lambda t: t.isin(vocabulary))
    narrow = docs.select(F.col(id_col).alias("id"), asked.alias("tokens"), *([F.col(scope_col)] if scope_col else [])).where(F.size("tokens") > 0)
    narrow = narrow.sortWithinPartitions(scope_col) if scope_col else narrow
    query_kind = to_arrow_type(queries.schema["query_id"].dataType)
    found = narrow.mapInArrow(score, schema)
    return top_per(found, ["query_id", "channel"], k, [F.desc(F.round("score", 9)), F.col("id")])


def best(ids: pa.Array, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the best k positive scores of each column, ties by id."""
    rows, columns = [], []
    place = np.empty(len(ids), np.int64)
    place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    for j in np.flatnonzero((scores > 0).any(axis=0)).tolist():
        column = scores[:, j]
        at = np.flatnonzero(column > 0)
        if len(at) > k:
            limit = np.partition(column[at], len(at) - k)[len(at) - k]
            at = at[column[at] >= limit - 1e-9 * max(1.0, abs(limit))]
        at = at[np.lexsort((place[at], -np.round(column[at], 9)))[:k]]
        rows.append(at)
        columns.append(np.full(len(at), j))
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def first_of(ids: pa.Array, columns: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Which of these scores are the best k of their column, ties by id."""
    place = np.empty(len(ids), np.int64)
    place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((place, -np.round(values, 9), columns))
    own = columns[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


# Dense vectors


def cosine(a: Column, b: Column) -> Column:
    """Cosine as a column, for few rows."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of the highest cosine for each query (query_id, vector), exactly. With
    ``within``, a column of both sides, only those that agree in it.

    Candidates and queries are dealt into blocks by hash; a task multiplies one block of each as matrices and passes
    on k rows per query. Vectors that are null, empty or zero take no part.
    """
    scope = F.col(within) if within else F.lit(0)
    held = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), scope.alias("scope"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("v"), scope.alias("scope"))
    ok = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    held, asked = (d.where(ok).withColumn("dim", F.size("v")) for d in (held, asked))
    n_blocks, n_sets = max(1, -(-held.count() // BLOCK)), max(1, -(-asked.count() // BLOCK))
    held = held.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_sets - 1).cast("long"))))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n_sets))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            unit = lambda v: (m := np.stack(v.to_numpy())) / np.linalg.norm(m, axis=1, keepdims=True)
            have, ids = unit(c["v"]), c["id"].to_numpy()
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                scores = have @ unit(part["v"]).T + 2  # positive, so that all take part
                at, column = best(pa.array(ids), scores, k)
                # As objects: strings of several frames would be put together in chunks, which Spark doesn't take.
                columns = {"query_id": part["query_id"].to_numpy()[column], "id": ids[at], "score": scores[at, column] - 2}
                out.append(pd.DataFrame({n: pd.Series(v, dtype=object if v.dtype == object else None) for n, v in columns.items()}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": c["id"].iloc[:0], "score": np.zeros(0)})

    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)[id_col]
    keys = ["scope", "dim", "qb", "cb"]
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(search, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    return top_per(found, ["query_id"], k, [F.desc(F.round("score", 9)), F.col("id")])


# Fusion


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): sum of 1 / (k + rank) over rankings (query_id, list, id, rank).

    Each position counts, also if a document is in a list twice. ``first_list`` and ``first_rank`` say where a document
    was seen first; they break ties: order by score descending, first_list, first_rank.
    """
    first = F.min(F.struct("list", "rank"))
    found = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), first.alias("_f"))
    return found.select("query_id", "id", "score", F.col("_f.list").alias("first_list"), F.col("_f.rank").alias("first_rank"))


def fuse_hits(hits: DataFrame) -> DataFrame:
    """One row per (query_id, kind, id) of hits (query_id, kind, id, channel, ranking, raw_score, ord, confidence, status).

    A hit's rank is its place, by ord, within its ranking (else its channel); it adds 1 / (60 + rank), its channel's
    boost, and for graph hits 0.02 of its raw score between 0 and 1. Confidence and an active status count once, from
    the first hit. score is rounded to 8 digits; match_confidence is strong with an exact or alias signal, moderate
    with two signals, else weak.
    """
    group = F.coalesce(F.col("ranking"), F.col("channel"))
    rank = F.row_number().over(Window.partitionBy("query_id", group).orderBy("ord"))
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHANNEL_BOOST.items() for x in kv]), "channel"), F.lit(0.0))
    graph = F.when((F.col("channel") == "graph") & F.col("raw_score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_score"))) * GRAPH_WEIGHT).otherwise(0.0)
    once = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_BOOST.items() for x in kv]), "confidence"), F.lit(0.0)) + F.when(F.col("status") == "active", ACTIVE_BOOST).otherwise(0.0)
    each = hits.withColumn("_rank", rank).withColumn("_add", 1.0 / (RRF_K + F.col("_rank")) + boost + graph).withColumn("_once", once)
    found = each.groupBy("query_id", "kind", "id").agg(F.sum("_add").alias("_sum"), F.min_by("_once", "ord").alias("_once"), F.array_sort(F.collect_set("channel")).alias("rank_signals"), F.min("ord").alias("ord"))
    strong = F.arrays_overlap("rank_signals", F.array(F.lit("exact"), F.lit("alias")))
    label = F.when(strong, "strong").when(F.size("rank_signals") >= 2, "moderate").otherwise("weak")
    return found.select("query_id", "kind", "id", F.round(F.col("_sum") + F.col("_once"), 8).alias("score"), "rank_signals", label.alias("match_confidence"), "ord")


def fused_order(df: DataFrame) -> list[Column]:
    """score descending, then kind, namespace, version, title whatever its case, id; columns that df lacks are left out."""
    rest = [F.col(c) for c in ("kind", "namespace", "version") if c in df.columns] + [F.lower("title")] * ("title" in df.columns)
    return [F.desc("score"), *rest, F.col("id")]


def top_ranked(fused: DataFrame, k: int) -> DataFrame:
    return top_per(fused, ["query_id"], k, fused_order(fused))


def hybrid_search(docs: DataFrame, queries: DataFrame, k: int, channel_k: int = 50, known: Known | None = None) -> DataFrame:
    """(query_id, id, score, rank): sparse and lexical channels of documents (doc_id, text) fused by reciprocal rank.

    The lexical channel ranks by how many distinct words of the query a document holds. Both read the documents once.
    """

    known = known or counted(docs, "text")

    def answer(some: DataFrame) -> DataFrame:
        return _scored(docs, "doc_id", "text", [word_channel(some, 0), sparse_channel(docs, some, "text", 1, known)], some, channel_k)

    lists = in_passes(queries, answer).select("query_id", F.col("channel").alias("list"), "id", "rank")
    return top_per(rrf(lists), ["query_id"], k, [F.desc(F.round("score", 12)), F.col("first_list"), F.col("first_rank")]).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


#: The channels of a source search, in the order in which a hit is named after them.
SOURCE_CHANNELS = ("exact", "sparse", "dense")


def source_search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", name_col: str = "name", key_col: str = "api_id", text_col: str = "text", vector_col: str = "dense_embedding") -> DataFrame:
    """(query_id, id, score, channel, rank): exact names, dense and sparse vectors of documents, fused by reciprocal rank.

    queries: (query_id, text, vector). Each channel gives k documents. A hit is named after the strongest of its
    channels: exact, sparse, dense. Ties go to the list that a document was seen in first (exact, dense, sparse) and
    its place there. Documents and queries without a vector are found by the other channels.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(key_col).alias("api_id"))
    exact = exact_names(queries, named, limit=k)
    dense = dense_top_k(docs, queries, k, id_col, vector_col)
    sparse = sparse_top_k(docs, queries, k, id_col, text_col)
    lists = exact.select("query_id", F.lit(0).alias("list"), "id", "rank").union(dense.select("query_id", F.lit(1), "id", "rank")).union(sparse.select("query_id", F.lit(2), "id", "rank"))
    lists = durable(lists)
    seen = lists.groupBy("query_id", "id").agg(F.collect_set("list").alias("_in"))
    channel = F.when(F.array_contains("_in", 0), "exact").when(F.array_contains("_in", 2), "sparse").otherwise("dense")
    found = rrf(lists).join(seen.select("query_id", "id", channel.alias("channel")), ["query_id", "id"])
    return top_per(found, ["query_id"], k, [F.desc(F.round("score", 12)), F.col("first_list"), F.col("first_rank")]).select("query_id", "id", F.round("score", 8).alias("score"), "channel", "rank")
