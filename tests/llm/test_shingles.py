import itertools
import random

import corpus_pipeline as P
import pytest
from corvia.llm import shingles as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(rows):
    """The smallest id of each class under links of Jaccard 0.8 or more, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[max(root(i), root(j))] = min(root(i), root(j))
    held = {}
    for i, (doc_id, _) in enumerate(rows):
        held.setdefault(root(i), []).append(doc_id)
    return sorted(min(c) for c in held.values())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("pairs", [8, 0])  # straight to the pairs, and by stars first
def test_stage_against_brute_force(spark, sf, monkeypatch, pairs):
    monkeypatch.setattr(S, "PAIRS", pairs)
    rng, rows = random.Random(4), []
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        rows += [" ".join(base)] + [edited(rng, base, max(1, len(base) * e // 100)) for e in (1, 2, 2, 3, 4)]
    base = [f"v{i}" for i in range(200)]
    rows += [edited(rng, base, e) for e in (1, 2, 3, 4) for _ in range(25)]  # one large group
    rows += ["a b", "a b", "a b c", "", " ", None, "x " * 40]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert sorted(r["doc_id"] for r in P.near_dedup(spark, docs, sf).collect()) == brute_kept(rows)


def test_rows_without_id_are_kept(spark):
    texts = ["one of a kind with quite a few words of its own", "another text that is like no other one here at all", "a third text which shares its id with the next one"]
    rows = [(None, texts[0]), (None, texts[0]), (3, texts[1]), (3, texts[2]), (None, texts[2])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert sorted(((r["doc_id"], r["text"]) for r in S.keep_one(docs).collect()), key=str) == sorted([(None, texts[0]), (3, texts[1]), (3, texts[2])], key=str)


def test_odd_rows(odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 8, 9007199254740993]
    assert S.keep_one(no_docs).count() == 0


def test_screen_loses_no_pair():
    rng = S.np.random.default_rng(8)
    for n in (5, 40, 300, 30_000):
        for share in (0.7, 0.88, 0.89, 0.9, 1.0):
            a = S.np.unique(rng.integers(0, 1 << 63, n, dtype=S.np.uint64))
            b = S.np.unique(S.np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n), dtype=S.np.uint64)]))
            assert not S.alike(a, b) or S.may_be_alike(S.brief_of(a), S.brief_of(b), len(a), len(b))
