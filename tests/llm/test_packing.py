import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from corvia.llm import packing as P

POOL = [*"abcXYZ .,;:!?'\"-_/\n\t\r 0123ÉéßÅœΣσςİıǅ漢字🙂́ \u0085\x1c\x1e<|>µ²½ªK", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", " don't "]


def test_words_give_the_ids_of_texts():
    encoder, rng = P.WordEncoder(P.tokenizer_file()), random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(POOL, k=rng.randint(0, 12)))
        assert encoder.encode_long(text).tolist() == encoder.encoder.encode(text, add_special_tokens=False).ids, text


def test_long_text_in_stretches(monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 100)
    encoder, text = P.WordEncoder(P.tokenizer_file()), "some words, and more. " * 300
    assert encoder.encode_long(text).tolist() == encoder.encoder.encode(text, add_special_tokens=False).ids


def unfold(moves):
    for length, first, ranks, sequence, fit, offset in moves:
        for i in range(ranks):
            yield length, first + i, sequence + i // fit, offset + i % fit * length


@pytest.mark.parametrize("seed", range(8))
def test_plan_fills_without_gaps(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), 64, 1, 33]) for _ in range(rng.randint(0, 400)))
    rows = list(unfold(P.plan(counts, 64)))
    assert Counter(r[0] for r in rows) == counts
    assert all(sorted(r[1] for r in rows if r[0] == n) == list(range(c)) for n, c in counts.items())
    bins = {}
    for length, _, sequence, offset in rows:
        bins.setdefault(sequence, []).append((offset, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(bins) == list(range(len(bins)))
    brute = []
    for n in sorted(counts.elements(), reverse=True):  # best fit over single pieces
        fit = min((r for r in brute if r >= n), default=None)
        if fit is None:
            brute.append(64 - n)
        else:
            brute[brute.index(fit)] = fit - n
    assert len(bins) <= len(brute)


def test_pack(odd_docs, no_docs):
    rows = P.pack(odd_docs, P.tokenizer_file(), with_ids=True).collect()
    encoder = Tokenizer.from_file(P.tokenizer_file())
    want = Counter()
    for d in odd_docs.collect():
        ids = [*encoder.encode(d["text"] or "", add_special_tokens=False).ids, P.END]
        for k in range(0, len(ids), P.SIZE):
            own = ids[k : k + P.SIZE]
            want[(d["doc_id"], k // P.SIZE, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= P.SIZE
    assert P.pack(no_docs, P.tokenizer_file()).count() == 0


def test_letter_words_give_the_same_ids():
    encoder, rng = P.WordEncoder(P.tokenizer_file()), random.Random(2)
    assert encoder.letters is not None
    words = {"".join(rng.choices("etaoinshrdluéèêçàßñüöäµªºÿbcfgkmpvwxyzjq", k=rng.randint(1, 24))) for _ in range(20_000)} | {"a" * 3000}
    words = sorted(w for w in words if P.LetterWords.takes(w))
    ids = [[int(encoder.letters.id_of[x]) for x in encoder.letters.piece(w.encode() + b"\xff")] for w in words]
    assert ids == [e.ids for e in encoder.encoder.encode_batch(words, add_special_tokens=False)]
