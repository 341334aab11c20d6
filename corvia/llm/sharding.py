"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form a group that stays whole. Groups are ordered by the MD5 of their text, and the order is cut
into ``shards`` runs so that the largest run is as small as possible. The smallest feasible capacity is found by
binary search: a capacity is feasible if a greedy walk, which fills each shard as far as it goes, needs no more than
``shards`` of them.

The walk needs no list of all groups. The driver holds an outline of the order: the bytes of each bucket of MD5
prefixes, a bounded number. A bucket is taken for a smooth run that may be cut anywhere (which bounds how far a walk
gets from above) or nowhere inside (from below). A capacity on which both agree is decided; the others leave a bracket,
and only the buckets in which a walk of the bracket may cut are opened, into sub-buckets first and into groups once
few are left. So every level reads a small share of the groups, and the last one decides exactly, whatever the size
of the largest group. Under that capacity the cuts lie as near to equal shares as the walk from the right allows, so
that the last shard isn't left short. They are keys of the order: a row's shard follows from its text, without a join.

Slots number the rows of a shard without gaps, by many tasks for each shard.

Defined results: a null text is empty, and equal to the empty text; an empty table gives no rows; repeated rows are
rows of their own with slots of their own; a null id is carried along; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import durable, ranked, spread

SHARDS = 24
#: Hexadecimal digits of the MD5 in the outline's first level, by which a level goes deeper, and in a full key.
STEP = 3
DEEPER = 2
WIDTH = 32
#: Groups that may be listed on the driver at once (each a key and a size).
LISTED = 100_000


class Outline:
    """The order of groups as entries (first key, bytes, whole): whole entries are single groups."""

    def __init__(self, entries: list[tuple[str, int, bool]]):
        self.entries = sorted(entries)
        self.ends = list(accumulate(e[1] for e in self.entries))
        self.total = self.ends[-1] if self.ends else 0

    def walk(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Positions in bytes after each shard: at least and at most what the greedy walk over groups reaches."""
        low, high, lows, highs = 0, 0, [], []
        for _ in range(shards):
            low, high = self._reach(low + capacity, False), self._reach(high + capacity, True)
            lows.append(low)
            highs.append(high)
        return lows, highs

    def _reach(self, target: int, most: bool) -> int:
        at = bisect_right(self.ends, target)
        if at == len(self.ends):
            return self.total
        start = self.ends[at - 1] if at else 0
        return target if most and not self.entries[at][2] else start

    def bracket(self, shards: int, low: int, high: int) -> tuple[int, int]:
        """Narrow (low, high]: the smallest feasible capacity is over low and at most high."""
        lo, hi = low, high
        while hi - lo > 1:  # the smallest capacity that is feasible even without cuts inside entries
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.walk(mid, shards)[0][-1] >= self.total else (mid, hi)
        feasible, lo, hi = hi, low, hi
        while hi - lo > 1:  # the largest that fails even with cuts anywhere
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.walk(mid, shards)[1][-1] < self.total else (lo, mid)
        return lo, feasible

    def open_entries(self, shards: int, low: int, high: int) -> list[str]:
        """Keys of the entries in which a walk with a capacity over low and at most high may cut."""
        lows, highs = self.walk(low + 1, shards)[0], self.walk(high, shards)[1]
        found, starts = [], [0, *self.ends[:-1]]
        for (key, _, whole), start, end in zip(self.entries, starts, self.ends, strict=True):
            if not whole and any(a < end and b >= start for a, b in zip(lows, highs, strict=True)):
                found.append(key)
        return found


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, key) for every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(id_col, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"))


def cut_keys(groups: DataFrame, shards: int = SHARDS, listed: int = LISTED) -> list[str]:
    """For groups (key, size), the smallest key of each shard after the first one."""

    def level(rows: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        prefix = F.substring("key", 1, digits) if digits < WIDTH else F.col("key")
        found = rows.groupBy(prefix.alias("p")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.max("size").alias("largest"))
        return [(r["p"], int(r["bytes"]), int(r["n"]), int(r["largest"])) for r in found.collect()]

    entries, largest = {}, 0
    for p, n_bytes, n, top in level(groups, STEP):
        entries[p], largest = (n_bytes, n), max(largest, top)
    total = sum(b for b, _ in entries.values())
    if not total:
        return []
    low, high, digits = max(-(-total // shards), largest) - 1, total, STEP
    while True:
        outline = Outline([(p, b, len(p) == WIDTH) for p, (b, _) in entries.items()])
        low, high = outline.bracket(shards, low, high)
        if high - low == 1:
            break
        if not (inside := outline.open_entries(shards, low, high)):
            break
        digits = WIDTH if sum(entries[p][1] for p in inside) <= listed else min(digits + DEEPER, WIDTH)
        deeper = level(_within(groups, inside), digits)
        for p in inside:
            del entries[p]
        entries |= {p: (b, n) for p, b, n, _ in deeper}
    edges, last, ends, cuts = [0, *outline.ends], 0, [], []
    end = total
    for _ in range(shards - 1):  # from the right: where each shard may start at the earliest
        end = edges[bisect_left(edges, end - high)]
        ends.append(end)
    for k, earliest in enumerate(reversed(ends), 1):
        ideal = max(earliest, min(k * total // shards, last + high))
        at = max(0, bisect_right(edges, ideal) - 1)
        if edges[at] < earliest or at + 1 < len(edges) and edges[at + 1] <= last + high and edges[at + 1] - ideal < ideal - edges[at]:
            at += 1
        last = edges[at]
        cuts.append(outline.entries[at][0] if at < len(outline.entries) else "~")
    return cuts


def _within(groups: DataFrame, prefixes: list[str]) -> DataFrame:
    """Groups under the given prefixes, which are of a few lengths."""
    held: Column = F.lit(False)
    for length in sorted({len(p) for p in prefixes}):
        held = held | F.substring("key", 1, length).isin([p for p in prefixes if len(p) == length])
    return groups.where(held)


def assign(rows: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """Rows (id, size, text_crc32, key) with shard and slot."""
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("size")))
    cuts = cut_keys(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("key") >= c).cast("int")
    placed = rows.withColumn("shard", shard).withColumn("_block", F.concat(F.substring("key", 1, 2), F.lpad(spread(F.col(id_col), n=64).cast("string"), 2, "0")))
    return ranked(placed, ["shard"], ["_block"], [F.col("key"), F.col(id_col)], "slot").drop("_block")


def query(docs: DataFrame) -> DataFrame:
    found = assign(durable(sized(docs)))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
