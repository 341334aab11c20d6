"""Near-duplicate classes by SimHash candidates and the Jaccard similarity of word shingles, checked on whole texts.

Two texts link if the sets of their ``SIZE``-word shingles have a Jaccard similarity of ``LEAST`` or more. Texts with
equal sets are one from the start. Fingerprints of the same shingles and their vantage-point trees (``simhash``) give
the first candidates, and so do equal fingerprints; they merge most near copies at little cost.

SimHash alone can't give right results here: two texts at 0.8 differ in 10 of 64 bits on average and in 16 or more at
times, and a ball of 16 bits holds unrelated fingerprints as well. So candidates of a second kind complete the first:
texts that share one of ``BANDS`` bands of ``ROWS`` minimum hashes each. A pair at 0.8 shares none with probability
(1 - 0.8^5)^40 = 1.3e-7, a pair of higher similarity with less. Every candidate of either kind is decided by its whole
sets, so no class holds a link under ``LEAST``. Before that, pairs are told apart where they meet by odd sketches: bit i
is the parity of the set's hashes in cell i, so two sets differ in at least as many hashes as their sketches in bits,
and a pair whose sketches differ in more than sets of the least similarity may is dropped, which loses none.

Buckets are never enumerated while they are large: trees and rounds of stars (each member against one of its buckets'
centres, of another class) merge their classes first, and only pairs of members that are still in different classes are
then compared, all of them.

Defined results: null and empty texts have the empty set and are one class; a text of fewer words than a shingle is its
own shingle; rows with a null id take part like any other and are kept if their class has no id. Sets and texts are told
apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import durable, per_text, quoted, release
from corvia.llm.simhash import components, extended, fingerprint_of, shingle_hashes, tree_candidates

SIZE = 5
#: Least similarity, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 5
#: Pairs whose sets are looked at at once.
ROWS_AT_ONCE = 512
#: Longs of an odd sketch.
ODD = 16
#: Shingles that are hashed at a time.
CHUNK = 1024
#: Pairs for each member of a bucket beyond which stars come first, the most rounds of them, and the share of members
#: (one in so many) that a round has to link for another to follow.
PAIRS, ROUNDS, STEADY = 8, 8, 20
#: Rows up to which the representatives of shared buckets are broadcast.
FEW = 100_000

_DRAWN = np.random.default_rng(17).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
_TIMES, _PLUS, _MIX = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1], np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    parts = list(shingle_hashes(text, size)) if text else []
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def bands_of(own: np.ndarray) -> np.ndarray:
    """One hash for each band of the set's minimum hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        mixed = own[at : at + CHUNK, None] * _TIMES
        mixed += _PLUS
        np.minimum(least, mixed.min(axis=0), out=least)
    held = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        held = (held ^ column) * _MIX
        held ^= held >> np.uint64(29)
    return held.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def key_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).astype(np.int64)) if len(own) else 0


def sketches(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep, and key (one for each set), n (its size), fp (the fingerprint), odd (its odd sketch) and bands (none for sets
    too small to be like another)."""

    def sketch(text: bytes | None) -> tuple[int, int, int, np.ndarray, np.ndarray | list]:
        parts = list(shingle_hashes(text, SIZE)) if text else []
        own = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        fp = np.array([fingerprint_of(parts)], np.uint64).view(np.int64)[0] if parts else 0
        return key_of(own), len(own), int(fp), odd_of(own), bands_of(own) if len(own) >= LEAST[0] else []

    def of():
        return lambda texts: (None, [list(c) for c in zip(*map(sketch, texts), strict=True)] if texts else [[]] * 5)

    return per_text(docs, keep, F.col(text_col).cast("binary"), [("key", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("odd", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))], of)


def odd_of(own: np.ndarray) -> np.ndarray:
    """The odd sketch of a set: the parities of its hashes in 64 * ODD cells."""
    cells = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * ODD), minlength=64 * ODD) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def brief_of(own: np.ndarray) -> np.ndarray:
    """The distinct lowest 16 bits of a set's hashes: a quarter of its bytes or less."""
    return np.unique(own.astype(np.uint16))


def may_be_alike(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """False only for sets of n and m hashes that can't be alike: what two sets share is at most the brief hashes that
    they share and the hashes that one of them lost by being brief."""
    both = len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))
    return LEAST[1] * both >= LEAST[0] * (n + m - both)


def arrays_of(column: pa.Array, kind) -> list[np.ndarray]:
    """The values of a binary column as arrays, where they lie."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [held[a:b].view(kind) for a, b in zip(at[:-1], at[1:], strict=True)]


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike; most others are told by their brief sets, so that few whole sets move."""

    def told(batches: Iterator[pa.RecordBatch], kind, ok) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                t = whole.slice(at, ROWS_AT_ONCE)
                x, y = (arrays_of(t[c], kind) for c in ("x", "y"))
                own = [ok(p, q, n, m) for p, q, n, m in zip(x, y, t["n"].to_pylist(), t["m"].to_pylist(), strict=True)]
                yield t.select(["a", "b"]).filter(pa.array(own, pa.bool_()))
        release()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from told(batches, np.uint16, may_be_alike)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from told(batches, np.uint64, lambda p, q, *_: alike(p, q))

    def with_sets(of: DataFrame, column: str) -> DataFrame:
        left, right = (sets.select(F.col("key").alias(k), F.col(column).alias(v), F.col("size").alias(c)) for k, v, c in (("a", "x", "n"), ("b", "y", "m")))
        return of.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")

    some = durable(with_sets(pairs, "brief").mapInArrow(screen, "a long, b long"))
    return with_sets(some, "own").mapInArrow(check, "a long, b long")


def _may(n: str, m: str) -> Column:
    """Whether sets of these sizes can be alike."""
    return (F.col(n) * LEAST[1] >= F.col(m) * LEAST[0]) & (F.col(m) * LEAST[1] >= F.col(n) * LEAST[0])


def _may_by_sketch(n: str, m: str, x: str, y: str) -> Column:
    """Whether sets of these sizes and odd sketches can be alike: by how many hashes they differ at least."""
    differ = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, ODD)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    return _may(n, m) & (differ * (LEAST[1] + LEAST[0]) <= (F.col(n) + F.col(m)) * (LEAST[1] - LEAST[0]))


def _near(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't tell apart."""
    side = lambda k, n, o: distinct.select(F.col("key").alias(k), F.col("n").alias(n), F.col("odd").alias(o))
    return pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").where(_may_by_sketch("n", "m", "x", "y")).select("a", "b")


def _tree_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of keys whose fingerprints are equal or linked by the trees, as stars."""
    fps = durable(distinct.groupBy("fp").agg(F.min("key").alias("rep")))
    linked = tree_candidates(fps.select("fp"))
    left, right = (fps.select(F.col("fp").alias(c), F.col("rep").alias(k)) for c, k in (("a", "x"), ("b", "y")))
    between = linked.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = distinct.join(fps, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return between.union(same).distinct()


def classes(rows: DataFrame, sets_of) -> DataFrame:
    """(node, label) of the distinct keys of rows (key, n, fp, bands) that are linked to another; a class's label is its smallest key.

    sets_of(keys) gives (key, own, brief, size): the sets, whole and brief as bytes, of the keys of a frame.
    """
    firsts = [F.first(c).alias(c) for c in ("n", "fp", "odd", "bands")]
    distinct = durable(rows.where(F.size("bands") > 0).groupBy("key").agg(*firsts))
    near = durable(_near(_tree_pairs(distinct), distinct))
    buckets = distinct.select("key", "n", F.explode("bands").alias("at"))
    crowded = buckets.groupBy("at").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("at")
    shared = durable(buckets.join(crowded, "at", "left_semi"))
    sets = durable(sets_of(shared.select("key").union(near.select("a")).union(near.select("b")).distinct()))
    found, last = components(durable(_checked(near, sets))), False
    for k in range(ROUNDS + 1):
        now = shared.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        each = now.groupBy("at").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(F.struct("key", "n", "label"), F.xxhash64("key", F.lit(k))).alias("p")).where("lo <> hi")
        now, each = durable(now), durable(each)
        size = each.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.lit(0.0)).alias("pairs")).first()
        if not size["rows"]:
            break
        last = last or k == ROUNDS or (k and size["pairs"] <= PAIRS * size["rows"])
        if last:  # all pairs of different classes that may be alike
            one = now.join(each.select("at"), "at", "left_semi").join(distinct.select("key", "odd"), "key")
            other = one.select("at", F.col("key").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("odd").alias("y"))
            pairs = one.join(other, "at").where((F.col("key") < F.col("b")) & (F.col("label") != F.col("other")) & _may_by_sketch("n", "m", "odd", "y")).select(F.col("key").alias("a"), "b")
        else:
            star = now.join(each.select("at", "p"), "at").select(F.col("key").alias("b"), "n", "label", F.col("p.key").alias("a"), F.col("p.n").alias("m"), F.col("p.label").alias("other"))
            star = star.where((F.col("label") != F.col("other")) & _may("n", "m")).select("a", "b").distinct()
            pairs = _near(star, distinct).groupBy("b").agg(F.min_by("a", F.xxhash64("a", F.lit(k))).alias("a"))
        pairs = durable(pairs.select("a", "b").distinct())
        new = durable(_checked(pairs, sets))
        found = extended(found, new)
        if last:
            break
        last = STEADY * BANDS * new.count() < size["rows"]  # stars that merge few of what is left have done their part
    return found


def sets_by(firsts: DataFrame, texts: DataFrame, at: list[str]):
    """The sets of a frame of keys: firsts says (key, at) where each key's text is among texts (at, text)."""

    def sets_of(keys: DataFrame) -> DataFrame:
        chosen = durable(firsts.join(keys, "key", "left_semi").select(*at, "key"))
        held = texts.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, at).dropDuplicates(["key"])

        def of():
            def both(found: list[bytes | None]):
                sets = [shingle_set(t) for t in found]
                return None, [[s.tobytes() for s in sets], [brief_of(s).tobytes() for s in sets], [len(s) for s in sets]]

            return both

        return per_text(held, ["key"], F.col("text").cast("binary"), [("own", pa.binary()), ("brief", pa.binary()), ("size", pa.int64())], of)

    return sets_of


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id of its class (null if no row of it has one)."""
    texts = docs.select(id_col, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_text"))
    rows = durable(sketches(texts, [id_col, "_text"]))
    firsts = durable(rows.groupBy("key").agg(F.min("_text").alias("_text"), F.min(id_col).alias("rep")))
    found = classes(rows, sets_by(firsts.select("key", "_text"), texts.select("_text", "text"), ["_text"]))
    labelled = firsts.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    smallest = durable(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    return rows.join(labelled.join(smallest, "label").select("key", "component_id"), "key").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, the one with the smallest id (null last), text hash and row hash; the columns of docs."""
    marked = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("_row"), "doc_id", "text", F.xxhash64(F.col("text")).alias("_text"), F.xxhash64(*[quoted(c) for c in docs.columns]).alias("_hash"))
    rows = durable(sketches(marked.select("doc_id", "text", "_text", "_hash"), ["doc_id", "_text", "_hash"]))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "_hash")).alias("first")
    firsts = durable(rows.groupBy("key").agg(first))
    found = classes(rows, sets_by(firsts.select("key", "first._text", "first._hash"), marked.select("text", "_text", "_hash"), ["_text", "_hash"]))
    labelled = firsts.join(found.withColumnRenamed("node", "key"), "key", "left").select("first", F.coalesce("label", "key").alias("label"))
    kept = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first._text", "first._hash")
    return marked.select("_row", "_text", "_hash").join(kept, ["_text", "_hash"], "left_semi").dropDuplicates(["_text", "_hash"]).select("_row.*")
