import itertools
import random

import numpy as np
import pytest
import xxhash

from corvia.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius=4):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= radius:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One TWO three", "a b c d", "É é A a B b\x1cx y z", "w " * 50 + "end", "x y z " * 40])
def test_fingerprint(text):
    assert (S.simhash(text.encode()) if text else 0) == brute_fingerprint(text)


def family(rng, n, flips):
    base, out = rng.getrandbits(64), set()
    while len(out) < n:
        x = base
        for b in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return out


@pytest.mark.parametrize(("members", "flips"), [(150, 2), (200, 3), (300, 6)])
def test_tree_finds_all_links(members, flips):
    rng = random.Random(members)
    fps = sorted({rng.getrandbits(64) for _ in range(300)} | family(rng, members, flips))
    assert S.tree_links(np.array(fps, np.uint64)).tolist() == brute_classes(fps)


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_masks_meet(agree):
    masks, rng = S.masks_for(agree), random.Random(agree)
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)


def test_classes_over_shards(spark, monkeypatch):
    rng = random.Random(9)
    fps = sorted({rng.getrandbits(64) for _ in range(400)} | family(rng, 120, 3) | family(rng, 80, 5))
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_classes(fps)
    for agree in (1, 2):
        found = {r["node"] % (1 << 64): r["label"] for r in S.components(S.shard_links(frame, S.masks_for(agree))).collect()}
        own = [found.get(x, x - (1 << 64) if x >> 63 else x) for x in fps]
        assert len(set(own)) == len(set(want))
        assert len(set(zip(own, want, strict=True))) == len(set(want))


def test_odd_rows(odd_docs):
    found = [(r["doc_id"], r["fp"], r["component_id"]) for r in S.near_duplicates(odd_docs).collect()]
    assert len(found) == odd_docs.count()
    by = {i: (f, c) for i, f, c in found if i is not None}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[4] == by[5]
    assert by[9007199254740993][1] == 9007199254740993


def test_keep_one(odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(set(ids)) and 4 in ids and 5 not in ids and 2 not in ids
    assert S.keep_one(no_docs).count() == 0


def test_a_tree_of_many_near_copies_holds_few_pairs_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(16_000)], np.uint64))
    tracemalloc.start()
    assert set(S.tree_links(fps).tolist()) == {0}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20, peak
