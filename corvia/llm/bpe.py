"""Byte-level byte-pair encoding and decoding, by replaying the merges over all words of a batch at once.

A text falls into the matches of a pattern (words), and each word's ids depend on its bytes alone. The distinct new
words of many documents lie one after another as a linked list of symbols. An inverted index leads from each pair's rank
to the places where the pair stands; ranks are applied in order, each at all its places, and a merge touches only the
pairs to its left and right, which enter the index. A rank below the one at hand can appear (two pairs may spell the
same bytes); the rest of the places then waits for it, so the result is that of merging each word alone, lowest rank
first and leftmost first. A word that is a token is that token.

The corpus of a replay is a stretch of a task's documents, and workers remember words up to a bound: a dictionary of
all words of all documents grows with them, and bringing it to the documents would shuffle every word of every text.

Defined results: a null text is the empty one, with no ids; an empty or null list decodes to no bytes; a list with an
id outside the vocabulary, or a null in it, decodes to null. Texts are encoded whole, whatever their length. Everything
is an expression of columns, so other columns, whatever their names, and repeated rows are untouched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import in_process, release
from corvia.llm.middle import slices
from corvia.llm.packing import tokenizer_file

#: Bytes of texts whose words are held at once; of a longer text, so many words at a time.
CHUNK, WORDS = 1 << 21, 1 << 17
#: Words that a Python worker remembers from task to task (in two halves: the older one goes), and the longest that it does.
KEPT_WORDS, KEPT_CHARS = 600_000, 48
#: Room for an id in a pair's key.
BITS = 24


class Vocabulary:
    """Ranks of byte strings from a file of lines (base64, rank); a rank is the id of its bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(raw): int(rank) for raw, rank in map(bytes.split, filter(bytes.strip, f))}
        self.bytes_of = {rank: raw for raw, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        #: Rank of the pair's bytes, for each pair of tokens that spells a token.
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for raw, rank in self.ranks.items():
            for cut in range(1, len(raw)):
                left, right = get(raw[:cut]), get(raw[cut:])
                if left is not None and right is not None:
                    self.pairs[left << BITS | right] = rank

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        symbols = np.array(self.single, np.int64)[data].tolist()
        n, pair = len(symbols), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for end in ends.tolist():
            after[end - 1] = -1
            if end < n:
                before[end] = -1
        where: dict[int, list[int]] = {}
        for at in range(n - 1):
            if after[at] > 0 and (rank := pair(symbols[at] << BITS | symbols[at + 1])) is not None:
                where.setdefault(rank, []).append(at)
        waiting = list(where)
        heapify(waiting)

        while waiting:
            rank = heappop(waiting)
            places = sorted(where.pop(rank))
            for done, at in enumerate(places, 1):
                gone = after[at]
                if gone < 0 or symbols[at] < 0 or pair(symbols[at] << BITS | symbols[gone]) != rank:
                    continue
                symbols[at], symbols[gone] = rank, -1
                after[at] = right = after[gone]
                left, least = before[at], rank
                if right >= 0:
                    before[right] = at
                    if (found := pair(rank << BITS | symbols[right])) is not None:
                        if found in where:
                            where[found].append(at)
                        else:
                            where[found] = [at]
                            heappush(waiting, found)
                            least = min(least, found)
                if left >= 0 and (found := pair(symbols[left] << BITS | rank)) is not None:
                    if found in where:
                        where[found].append(left)
                    else:
                        where[found] = [left]
                        heappush(waiting, found)
                        least = min(least, found)
                if least < rank and done < len(places):  # a lower rank has come up: the others wait for it
                    where[rank] = places[done:]
                    heappush(waiting, rank)
                    break
        symbols = np.array(symbols, np.int64)
        alive = symbols >= 0
        last = np.cumsum(alive)[ends - 1] * 4
        packed = symbols[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *last.tolist()[:-1]], last.tolist(), strict=True)]


class Encoder:
    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.split = in_process("bpe", path, Vocabulary), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def look_up(self, texts: list[list[str]]) -> dict[str, bytes]:
        """The ids of all words of the texts; new ones are replayed together, short ones are remembered."""
        distinct = set().union(*texts)
        if len(self.known) > KEPT_WORDS // 2:
            self.known, self.older = {}, self.known
        known, older, ranks = self.known, self.older, self.vocabulary.ranks
        known |= {w: older[w] for w in distinct if w in older}
        found = {w: known[w] for w in distinct if w in known}
        new = [w for w in distinct if w not in found]
        raw = [w.encode() for w in new]
        merged = [(w, r) for w, r in zip(new, raw, strict=True) if r not in ranks]
        fresh = {w: ranks[r].to_bytes(4, "little") for w, r in zip(new, raw, strict=True) if r in ranks}
        fresh |= zip([w for w, _ in merged], self.vocabulary.replay([r for _, r in merged]), strict=True)
        known |= {w: ids for w, ids in fresh.items() if len(w) <= KEPT_CHARS}
        return found | fresh

    def encode_long(self, text: str) -> bytes:
        matches, parts = (m.group() for m in self.split.finditer(text)), []
        while words := list(islice(matches, WORDS)):
            parts.append(b"".join(map(self.look_up([words]).__getitem__, words)))
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        if len(texts) == 1:
            return [self.encode_long(texts[0])]
        words = [self.split.findall(t) for t in texts]
        ids = self.look_up(words).__getitem__
        return [b"".join(map(ids, own)) for own in words]


def _lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def encode(text: Column, ranks_file: str, pattern: str) -> Column:
    """The ids (array<int>) of a text, each match of the pattern on its own; the file lies at the same path everywhere."""

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = in_process("bpe-words", (ranks_file, pattern), lambda key: Encoder(*key))
        for texts in batches:
            made = [_lists(encoder.encode(texts[a:b].to_pylist())) for a, b in slices(texts, CHUNK)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.int32()))
        release()

    return ids_of(F.coalesce(text, F.lit("")))


def _per_list(kind: str, of: Callable[[], Callable[[np.ndarray], object]], arrow: pa.DataType):
    """A function of lists of ids; a null list is an empty one, a list with a null gives null."""

    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = of()
        for lists in batches:
            flat, at = lists.values, np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            lo, hi = (int(at[0]), int(at[-1])) if len(lists) else (0, 0)
            flat = flat.slice(lo, hi - lo)
            holes = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
            ids, empty = flat.fill_null(0).to_numpy(zero_copy_only=False), lists.is_null().to_pylist()
            found = []
            for i, none in enumerate(empty):
                a, b = (0, 0) if none else (int(at[i]) - lo, int(at[i + 1]) - lo)
                found.append(None if holes is not None and holes[a:b].any() else work(ids[a:b]))
            yield pa.array(found, arrow)
        release()

    return apply


def decode(ids: Column, ranks_file: str) -> Column:
    """The bytes (binary) that the ids spell."""

    def of():
        spelt = in_process("bpe", ranks_file, Vocabulary).bytes_of

        def join(own: np.ndarray) -> bytes | None:
            try:
                return b"".join(map(spelt.__getitem__, own.tolist()))
            except KeyError:
                return None

        return join

    return _per_list("binary", of, pa.binary())(ids)


def ids_sha256(ids: Column) -> Column:
    """SHA-256 (lowercase hexadecimal) of the ids as little-endian unsigned 32-bit integers."""
    return _per_list("string", lambda: lambda own: hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), pa.string())(ids)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    ids = F.col("ids")
    found = docs.select("doc_id", encode(F.col("text"), path, public_tokenizers.PATTERN).alias("ids"))
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids_sha256(ids).alias("ids_sha256"), F.sha2(decode(ids, path), 256).alias("decoded_sha256"))
