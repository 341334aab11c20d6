import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corvia.llm import bpe as B
from corvia.llm.packing import tokenizer_file

POOL = [*"abcdefghijklmnop ETAOIN .,;:!?'\"-_/\n\t\r 0123ÉéßÅΣςİ漢字🙂́\u0085\x1c\x1e᠎​ 　<|>", "'s", "'LL", " don't ", "the", "ing", "aaaa", "<|endoftext|>"]


def library(name):
    with open(tokenizer_file(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_the_librarys(name):
    own, rng = library(name), random.Random(3)
    encoder = B.Encoder(tokenizer_file(name), public_tokenizers.PATTERN)
    for _ in range(400):
        texts = ["".join(rng.choices(POOL, k=rng.randint(0, 60))) for _ in range(5)]
        texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x2000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(8)), "a" * rng.randint(1, 3000), "ab" * 300]
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text), text


def test_a_lower_rank_can_come_up(tmp_path):
    """Pairs may spell a token of a lower rank than one of their parts; each word alone decides."""
    rng = random.Random(8)
    for seed in range(30):
        rng.seed(seed)
        tokens = {bytes(rng.choices(b"ab", k=rng.randint(2, 5))) for _ in range(12)}
        lines = [*(bytes([b]) for b in range(256)), *rng.sample(sorted(tokens), len(tokens))]
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(lines)))
        vocabulary = B.Vocabulary(str(path))
        words = [bytes(rng.choices(b"ab", k=rng.randint(1, 14))) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.replay(words)] == [merge(w, vocabulary.ranks) for w in words]


def merge(word, ranks):
    """One merge at a time: the lowest rank, the leftmost of equal ones."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_query(odd_docs, no_docs):
    own = library("byte_bpe_50k.tiktoken")
    want = []
    for d in odd_docs.collect():
        ids = own.encode_ordinary(d["text"] or "")
        want.append((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()))
    got = [tuple(r) for r in B.query(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert B.query(no_docs).count() == 0


def test_query_over_stored_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = library("byte_bpe_50k.tiktoken")
    want = {d["doc_id"]: (len(ids := own.encode_ordinary(d["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()) for d in docs.collect()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in B.query(docs).collect()} == want


def test_long_texts_and_forgotten_words(monkeypatch):
    own = library("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(B, "WORDS", 7)
    monkeypatch.setattr(B, "KEPT_WORDS", 20)
    encoder, rng = B.Encoder(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(1)
    for _ in range(30):
        text = "".join(rng.choices(POOL, k=200))
        assert np.frombuffer(encoder.encode_long(text), "<u4").tolist() == own.encode_ordinary(text)
        assert np.frombuffer(encoder.encode([text, "x"])[0], "<u4").tolist() == own.encode_ordinary(text)
        assert len(encoder.known) + len(encoder.older) < 400


def test_lists_that_are_no_texts(spark):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(0, None), (1, []), (2, [464, None]), (3, [464, 99_999_999]), (4, [464]), (5, [464, 464])], "k int, ids array<int>").coalesce(1)
    got = {r["k"]: r["raw"] for r in rows.select("k", B.decode(F.col("ids"), path).alias("raw")).collect()}
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == {0: b"", 1: b"", 2: None, 3: None, 4: b"The", 5: b"TheThe"}
