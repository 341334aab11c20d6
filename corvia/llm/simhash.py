"""SimHash fingerprints and near-duplicate classes by vantage-point trees.

Fingerprints are 64-bit SimHashes of word shingles; two of them link at ``radius`` or fewer differing bits. Only
distinct fingerprints are searched. Hamming distance on a fixed set of bits is a pseudo-metric, and the distances on
disjoint sets add up to the whole distance; so of ``radius + k`` disjoint blocks, a linked pair is at distance 0 on
at least ``k``. The forest's first level therefore shards by distance 0 on each choice of k blocks: every fingerprint
goes to each shard whose ball it touches (the overlap at the boundaries), and every linked pair meets in at least one
shard. ``k`` grows with the number of fingerprints, which keeps shards small. Within a shard a vantage-point tree
over the full Hamming distance is searched: the triangle inequality drops a branch that is out of reach, and takes in
whole a branch that is within reach. Shards return a spanning forest of their links, so a shard of m fingerprints
returns fewer than m links, and no class is lost. A shard of over ``HOT`` fingerprints is dealt into parts by hash, and
each pair of parts is a task of its own, so no task holds more than two parts.

A tree without that first level would be exact too, but unrelated fingerprints lie at 32 +- 4 bits: a ball of 4 bits
around any threshold holds two thirds of all points, and its work grows almost as the square of the input.

``near_duplicates`` and ``keep_one`` decide by similarity: fingerprints of five-word shingles and their trees give the
first candidates, ``shingles`` completes them and checks each by the whole texts. ``fingerprint_classes`` are the
classes of fingerprints alone.

Defined results: a null or empty text has the fingerprint 0 and links like any other; rows with a null id get the
class of their fingerprint, and null if no row of the class has an id; repeated rows stay; columns of other names are
ignored, or carried along by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import ROWS, durable, per_text, release

RADIUS = 4
#: Words of a shingle where a contract says so; ``shingles.SIZE`` holds elsewhere.
SHINGLE = 4
#: Shingles whose bits are summed up at a time; bounds the memory of a very long text.
CHUNK = 1 << 16
#: Members of a leaf of a tree, which are compared directly, and pairs of a leaf that are looked at and joined at a time.
LEAF, PAIRS = 48, 1 << 17
#: Expected unrelated fingerprints in a shard; beyond it shards take one more block.
SHARD = 2048
#: Fingerprints of a shard that one task takes; and how many larger shards may be broadcast.
HOT, FEW = 1 << 16, 10_000


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The XXH64 (seed 42) of the text's shingles in order, repeats included, some at a time; none without words."""
    import xxhash

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        yield np.array([digest(line, 42)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1]
    stops = ends[size - 1 :] - 1
    for at in range(0, len(starts), CHUNK):
        some = zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)
        yield np.fromiter((digest(line[a:b], 42) for a, b in some), np.uint64, min(CHUNK, len(starts) - at))


def fingerprint_of(hashes: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """Bit b is 1 if set in over half of the hashes."""
    n, ones = 0, np.zeros(64, np.int64)
    for some in hashes:
        n += len(some)
        ones += np.unpackbits(some.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits((2 * ones > n).astype(np.uint8)).tobytes(), "big")


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 without words."""
    return fingerprint_of(shingle_hashes(text, size))


def fingerprints(docs: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer; several columns may be kept as the id."""

    def of():
        return lambda texts: (None, [np.array([simhash(t, size) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)])

    return per_text(docs, [id_col] if isinstance(id_col, str) else id_col, F.col(text_col).cast("binary"), [("fp", pa.int64())], of)


def blocks_for(n: int, radius: int = RADIUS, shard: int = SHARD) -> int:
    """How many blocks must agree, so that unrelated fingerprints share a shard with about ``shard`` others."""
    agree = 1
    while agree < 4 and n / 2 ** (64 * agree / (radius + agree)) > shard:
        agree += 1
    return agree


def masks_for(agree: int, radius: int = RADIUS) -> list[int]:
    """One mask for each choice of ``agree`` of the ``radius + agree`` disjoint blocks of bits."""
    cuts = [round(64 * i / (radius + agree)) for i in range(radius + agree + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, agree)]


class Forest:
    """Union by smallest index; edges are the links that joined two classes."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def roots(self, x: np.ndarray) -> np.ndarray:
        found = self.up[x]
        while not np.array_equal(further := self.up[found], found):
            found = further
        return found

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Link x[i] to y[i]; only pairs of different classes are gone through one by one."""
        pairs = np.stack([self.roots(x), self.roots(y)])
        differ = np.flatnonzero(pairs[0] != pairs[1])
        pairs, first = np.unique(pairs[:, differ], axis=1, return_index=True)
        for (a, b), i in zip(pairs.T.tolist(), differ[first].tolist(), strict=True):
            while self.up[a] != a:
                a = int(self.up[a])
            while self.up[b] != b:
                b = int(self.up[b])
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.edges.append((int(x[i]), int(y[i])))


def distances(fps: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ to)


def tree_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints, the index of the smallest one of each one's class under links in this shard."""
    return tree_forest(fps, radius).roots(np.arange(len(fps)))


def tree_forest(fps: np.ndarray, radius: int = RADIUS) -> Forest:
    """The classes of distinct fingerprints under links in this shard, and a link for every step of joining them.

    The tree and the members that can reach a branch go down together: a branch holds its members and the queries
    that a member may be within radius of. The vantage point splits members at the median distance; by the triangle
    inequality a query at distance d can't reach members at distances over d + radius or under d - radius. If the
    farthest member is at distance f with f + d <= radius, the whole branch is linked to the query.
    """
    forest = Forest(len(fps))
    todo = [(np.arange(len(fps)), np.arange(len(fps)))]
    while todo:
        members, queries = todo.pop()
        if not len(members) or not len(queries):
            continue
        if len(members) <= LEAF:
            step = PAIRS // len(members)
            for at in range(0, len(queries), step):
                own = queries[at : at + step]
                close = np.bitwise_count(fps[own][:, None] ^ fps[members][None, :]) <= radius
                close &= own[:, None] != members[None, :]
                if close.any():
                    i, j = np.nonzero(close)
                    forest.join(own[i], members[j])
            continue
        vantage = members[len(members) // 2]
        to_members, to_queries = distances(fps[members], fps[vantage]), distances(fps[queries], fps[vantage])
        far = int(to_members.max())
        taken = to_queries.astype(np.int64) + far <= radius
        if taken.any():  # all of the branch is linked through the vantage point
            linked = np.concatenate([queries[taken], members])
            forest.join(linked, np.full(len(linked), vantage))
            queries, to_queries = queries[~taken], to_queries[~taken]
        linked = queries[to_queries <= radius]
        forest.join(linked, np.full(len(linked), vantage))
        others = members != vantage
        members, to_members = members[others], to_members[others]
        cut = int(np.median(to_members))
        near = to_members <= cut
        if near.all():  # ties: the ring itself is split
            ring = to_members == cut
            near = ~ring if not ring.all() else np.arange(len(members)) < len(members) // 2
        for part in (near, ~near):
            if part.any():
                low, high = int(to_members[part].min()) - radius, int(to_members[part].max()) + radius
                todo.append((members[part], queries[(to_queries >= low) & (to_queries <= high)]))
    return forest


def shard_links(fps: DataFrame, masks: list[int], radius: int = RADIUS, hot: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints, a spanning forest for each shard (for each two parts of a hot one)."""
    signed, hot = [m - (1 << 64) if m >> 63 else m for m in masks], hot or HOT
    keys = F.array(*[F.struct(F.lit(i).alias("tree"), F.col("fp").bitwiseAND(F.lit(m)).alias("at")) for i, m in enumerate(signed)])
    sharded = fps.select("fp", F.explode(keys).alias("shard")).select("shard.tree", "shard.at", "fp")
    crowded = durable(sharded.groupBy("tree", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("tree", "at", F.ceil(F.col("n") / hot).cast("int").alias("parts")))
    if n := crowded.count():
        dealt = sharded.join(F.broadcast(crowded) if n <= FEW else crowded, ["tree", "at"], "left")
        own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
        with_each = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda y: F.struct(F.least(own, y).alias("i"), F.greatest(own, y).alias("j")))
        dealt = dealt.select("tree", "at", F.explode(with_each).alias("p"), "fp").select("tree", "at", "p.i", "p.j", "fp")
    else:
        dealt = sharded.select("tree", "at", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    names = ["tree", "at", "i", "j"]
    dealt = dealt.repartition(*names).sortWithinPartitions(*names, "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for fp in _shards(batches, names):
            linked = np.array(tree_forest(fp.view(np.uint64), radius).edges, np.int64).reshape(-1, 2)
            a.append(fp[linked[:, 0]])
            b.append(fp[linked[:, 1]])
            if len(a) == ROWS:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
        del a, b
        release()

    return dealt.mapInPandas(search, "a long, b long")


def _shards(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[np.ndarray]:
    """The fingerprints of each shard with two or more, from sorted batches; a shard may go on over several."""
    open_key, parts = None, []
    for batch in batches:
        if batch.empty:
            continue
        keys, fp = [batch[c].to_numpy() for c in names], batch["fp"].to_numpy()
        new = np.zeros(len(fp), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        starts = np.r_[0, np.flatnonzero(new)]
        stops = np.r_[starts[1:], len(fp)]
        first, last = (tuple(k[i] for k in keys) for i in (0, -1))
        if parts and first == open_key:
            parts.append(fp[: stops[0]])
        else:
            if parts and sum(map(len, parts)) > 1:
                yield np.concatenate(parts)
            parts = [fp[: stops[0]]]
        if len(starts) > 1:
            if sum(map(len, parts)) > 1:
                yield np.concatenate(parts)
            for i in np.flatnonzero(stops[1:-1] - starts[1:-1] > 1).tolist():
                yield fp[starts[i + 1] : stops[i + 1]]
            parts = [fp[starts[-1] :]]
        open_key = last
    if parts and sum(map(len, parts)) > 1:
        yield np.concatenate(parts)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from each node of the links (a, b).

    Large-star and small-star steps over the links until they are stars around the smallest nodes; each is a minimum
    per node (summed map-side) and a join, and the links never leave the executors. Minima are written before they are
    joined, so that a node of very many links is one row on one side and the other can be split.
    """
    links = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(links):
        both = links.union(links.select("b", "a"))
        least = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        links = durable(small.where("a <> b").distinct())
    centres = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(centres)


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one, which has none itself."""
    ends = F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    per = links.select(F.explode(ends).alias("e")).groupBy("e.x").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return not per.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def extended(found: DataFrame, new: DataFrame) -> DataFrame:
    """Classes (node, label) after new links (a, b) between nodes, known or not: only classes that these link are joined."""
    side = lambda c: found.select(F.col("node").alias(c), F.col("label").alias(f"_{c}"))
    named = new.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    named = durable(named)
    moved = components(named.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = named.select(F.col("a").alias("node")).union(named.select("b")).distinct().join(found.select("node"), "node", "left_anti")
    whole = found.union(nodes.select("node", F.col("node").alias("label")))
    up = moved.select(F.col("node").alias("label"), F.col("label").alias("_to"))
    return durable(whole.join(up, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))


def tree_candidates(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of distinct fingerprints (fp) that hold their classes together."""
    return shard_links(fps, masks_for(blocks_for(fps.count(), radius), radius), radius)


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id of its fingerprint's class."""
    rows = durable(fingerprints(docs, id_col, text_col, size))
    fps = durable(rows.groupBy("fp").agg(F.min(id_col).alias("rep")))
    found = components(tree_candidates(fps.select("fp"), radius))
    labelled = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    smallest = durable(labelled.groupBy("label").agg(F.min("rep").alias("component_id")))
    classes = labelled.join(smallest, "label").select("fp", "component_id")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id of its class of similar texts."""
    from corvia.llm import shingles  # which builds on this module

    return shingles.near_duplicates(docs, id_col, text_col)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of similar texts; the columns of docs."""
    from corvia.llm import shingles

    return shingles.keep_one(docs)


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
