import hashlib
import random
import zlib

import pytest

from corvia.llm import sharding as S


def brute_capacity(sizes, shards):
    def feasible(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards

    low, high = 0, sum(sizes)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid, high)
    return high


@pytest.mark.parametrize(("n", "shards", "giant", "listed"), [(400, 24, 0, 50), (3000, 24, 0, 20), (300, 5, 100_000, 10), (10, 24, 0, 5), (1, 24, 0, 5)])
def test_smallest_capacity(spark, n, shards, giant, listed):
    rng = random.Random(n + shards)
    groups = sorted((hashlib.md5(str(i).encode()).hexdigest(), rng.randint(8, 3000)) for i in range(n))
    if giant:
        groups[n // 3] = (groups[n // 3][0], giant)
    cuts = S.cut_keys(spark.createDataFrame(groups, "key string, size long"), shards, listed)
    held = {}
    for key, size in groups:
        shard = sum(key >= c for c in cuts)
        held[shard] = held.get(shard, 0) + size
    assert max(held.values()) == brute_capacity([s for _, s in groups], shards)
    assert max(held) < shards


def test_query(odd_docs, no_docs):
    rows = S.query(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] is not None:
            data = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    by = {r["doc_id"]: r["shard"] for r in rows}
    assert by[1] == by[2] and by[4] == by[5]
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and 0 <= shard < 24
    assert S.query(no_docs).count() == 0
