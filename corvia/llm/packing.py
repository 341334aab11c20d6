"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents become pieces of at most ``size`` tokens. How many pieces have each length (at most ``size`` counts) is all
that the plan needs: lengths are placed in descending order, each into the open sequences with the least room that
still takes it, many equal ones at a time. A planned move says that the pieces of rank r to s within one length take
places in a run of sequences. Pieces then look up their move by (length, rank), so no document reaches the driver.
The plan is bounded by ``size`` alone: each length opens one run of sequences and splits one at most, so it has
O(size) runs, whatever the number of documents.

Defined results: a null or empty text is the end token alone; repeated rows are packed once each; a null id is carried
along; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.llm.common import durable, in_process, per_text, ranked, spread

SIZE = 4096
END = 1
#: Distinct words whose token ids a task keeps at once.
KEPT_WORDS = 500_000
#: Marks that a word's stem may be followed by; a run of them is a token run of its own.
MARKS = ".,;:!?"
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Characters tokenized at a time, and so the memory of a very long text.
CHUNK = 1 << 20


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class LetterWords:
    """The same byte-pair merges run by a faster library, for words of lower-case Latin-1 letters.

    Such a word is one run for the pre-tokenizer and is not changed by the normalizer, so its ids are those of the
    merges over its bytes. The end of a word is a byte of its own here, FF, that the last byte takes in before all
    other merges.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        end = model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in set(printable))
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

        def raw(token: str) -> bytes:
            whole = token.endswith(end)
            return bytes(byte_of[c] for c in (token[: -len(end)] if whole else token)) + b"\xff" * whole

        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 255]): 256 + b for b in range(255)}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t.removesuffix(end))}
        self.id_of = np.array([ids.get(token, 0) for token in ranks], np.uint32)
        self.piece = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @staticmethod
    def of_file(path: str) -> LetterWords | None:
        """None for a tokenizer of another make."""
        try:
            return LetterWords(path)
        except (KeyError, TypeError, AttributeError, ValueError):
            return None

    @staticmethod
    def takes(word: str) -> bool:
        return word.isalpha() and word.islower() and is_latin(word)


class WordEncoder:
    """Token ids of texts by way of their distinct words.

    The vocabulary's pre-tokenizer never joins text across white space, and its normalizer works on characters (NFC,
    lower case, white space to a space), so the ids of a text are those of its words, and the ids of a word are those
    of its stem and of the marks at its end. Only new stems are encoded; ids are gathered with numpy. Texts of Latin-1
    characters are put in lower case first, which the normalizer would do alike. Texts with the separators 1C to 1F,
    which are white space for Python alone, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder, self.letters = Tokenizer.from_file(path), LetterWords.of_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def keep(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Take in new words and their ids, one after another."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def encode_new(self, words: list[str]) -> None:
        plain = [w for w in words if LetterWords.takes(w)] if self.letters else []
        if plain:
            piece = self.letters.piece
            found = [piece(w.encode() + b"\xff") for w in plain]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.keep(plain, lengths, self.letters.id_of[np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))])
        others = [w for w in words if w not in self.known] if plain else words
        found = [e.ids for e in self.encoder.encode_batch(others, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.keep(others, lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())))

    def learn(self, words: list[str]) -> None:
        """Learn distinct new words: those with marks at their end from their stem and the marks."""
        known, marked, ends, new = self.known, [], [], {}
        for word in words:
            stem = word.rstrip(MARKS)
            if stem == word or not stem or stem[-1] >= "\u0100" or not stem[-1].isalnum():  # others may end in a mark once normalized
                new[word] = None
            else:
                marked.append(word)
                ends += [stem, word[len(stem) :]]
        new |= dict.fromkeys(e for e in ends if e not in known)
        self.encode_new(list(new))
        if marked:  # none of them is a stem or an end itself
            at = np.fromiter(map(known.__getitem__, ends), np.int64, len(ends))
            self.keep(marked, self.lengths[at].reshape(-1, 2).sum(axis=1), self.gather(at))

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of words by their places, one after another."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.starts[places] - ends + lengths, lengths)]

    def split(self, text: str) -> list[str] | None:
        """The words of a text in the form in which they are looked up; None for a text to be encoded as it is."""
        if SEPARATORS.search(text):
            return None
        return (text.lower() if "<|" not in text and is_latin(text) else text).split()

    def encode_words(self, words: list[str], places: dict[str, int]) -> np.ndarray:
        """Unsigned 32-bit ids of words by their places."""
        if not words:
            return np.zeros(0, np.uint32)
        return self.gather(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text; their new words are learned together."""
        split = [self.split(t) for t in texts]
        if len(self.known) > KEPT_WORDS:
            self.clear()
        distinct: set[str] = set()
        for words in split:
            distinct.update(words or ())
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        known = self.known
        places = {w: known[w] for w in distinct}  # a small table stays in the processor's cache
        for text, words in zip(texts, split, strict=True):
            yield np.array(self.encoder.encode(text, add_special_tokens=False).ids, np.uint32) if words is None else self.encode_words(words, places)

    def encode_long(self, text: str) -> np.ndarray:
        """The ids of one text, a stretch of it at a time; stretches end at white space."""
        parts, at = [], 0
        while at < len(text):
            stop = min(len(text), at + CHUNK)
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            parts += self.encode_all([text[at:stop]])
            at = stop
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, many short ones or one long one at a time."""
        lo, held = 0, 0
        for i, text in enumerate([*texts, None]):
            if text is None or held + len(text) > CHUNK:
                if held > CHUNK:
                    yield self.encode_long(texts[lo])
                else:
                    yield from self.encode_all(texts[lo:i])
                lo, held = i, 0
            held += len(text or "")


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32 [, ids]): every document's tokens and the end token, cut at ``size``."""

    def of():
        encoder = in_process("encoder", tokenizer_path, WordEncoder)

        def cut(texts: list[str | None]):
            out = []
            for i, found in enumerate(encoder.encode_texts([t or "" for t in texts])):
                ids = np.append(found, np.uint32(END)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), size)):
                    own = ids[start : start + size]
                    out.append((i, k, start, len(own), zlib.crc32(own.tobytes()), own if with_ids else None))
            columns = [list(c) for c in zip(*out, strict=True)] or [[] for _ in range(6)]
            return columns[0], columns[1 : 5 + with_ids]

        cut.done = encoder.clear  # the vocabulary stays loaded, learned words don't
        return cut

    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] if with_ids else []
    return per_text(docs, [id_col], F.col(text_col), fields, of)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: moves (length, first rank, ranks, first sequence, pieces a sequence, offset).

    The pieces of ranks first to first + ranks - 1 of that length go to sequences one after another, so many to each,
    from the offset on.
    """
    moves, room, runs, opened = [], [], defaultdict(list), 0

    def keep(left: int, first: int, n: int) -> None:
        if left and n:
            if not runs[left]:
                insort(room, left)
            runs[left].append((first, n))

    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        rank, rest = 0, counts[length]
        while rest and (at := bisect_left(room, length)) < len(room):
            left = room[at]
            first, n = runs[left].pop()
            if not runs[left]:
                room.pop(at)
            fit = left // length
            full = min(n, rest // fit)
            if full:
                moves.append((length, rank, full * fit, first, fit, size - left))
                keep(left - fit * length, first, full)
                rank, rest, first, n = rank + full * fit, rest - full * fit, first + full, n - full
            if n and rest:  # fewer are left than one more sequence takes
                moves.append((length, rank, rest, first, rest, size - left))
                keep(left - rest * length, first, 1)
                rank, rest, first, n = rank + rest, 0, first + 1, n - 1
            keep(left, first, n)
        if rest:
            fit = size // length
            full = rest // fit
            if full:
                moves.append((length, rank, full * fit, opened, fit, 0))
                keep(size - fit * length, opened, full)
                opened, rank, rest = opened + full, rank + full * fit, rest - full * fit
            if rest:
                moves.append((length, rank, rest, opened, rest, 0))
                keep(size - rest * length, opened, 1)
                opened += 1
    return moves


def place(cut: DataFrame, size: int = SIZE, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, length, ids_crc32)."""
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = sorted(plan(counts, size))
    table = np.array(moves, np.int64).reshape(-1, 6).T
    keys = table[0] << 40 | table[1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, lengths = (batch.column(c).to_numpy() for c in ("_rank", "length"))
            at = np.searchsorted(keys, lengths << 40 | rank, side="right") - 1
            length, first, _, sequence, fit, offset = table[:, at]
            turn = rank - first
            made = [pa.array(sequence + turn // fit), pa.array(offset + turn % fit * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], [*columns, "sequence_id", "offset"])

    columns = cut.columns
    salted = cut.withColumn("_salt", spread(F.col(id_col), F.col("piece"), n=256))
    numbered = ranked(salted, ["length"], ["_salt"], [F.col(id_col), F.col("piece"), F.col("ids_crc32")], "_rank")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.select(*columns, "_rank").mapInArrow(look_up, schema)


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    return place(durable(pieces(docs, tokenizer_path, size, with_ids)), size)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
