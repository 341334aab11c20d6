"""Language identification by a linear-chain conditional random field over the words of code-switched text.

A document is a sequence of words, cut into chains of at most ``CHAIN`` words (the chains cover the whole text). Each
word has a score per language, the sum of learned weights of its features: character 1-, 2- and 3-grams with the
word's edges marked (those at the edges are its affixes) and the word itself (the lexicon, with buckets of its own).
Learned transitions score one language after another. Forward-backward gives each word's probabilities; a document's language is the one with
the largest sum over its words with letters, and its score is that sum's share.

Features are computed with numpy over the distinct words of a batch, and forward-backward runs over all chains of a
batch side by side, so that a word costs a few hundred nanoseconds.

Training: at most ``SAMPLE`` distinct texts per language, the first by hash among the labelled training rows, and of
each at most ``SAMPLE_CHARS`` characters (a stretch that the hash picks). Words take their document's label; half of the
chains splice runs of two documents, so that transitions see switches. The weights are fitted by AdaGrad on the driver.
All languages are learned: each takes half a megabyte of weights, on the driver and in every worker, and at most
``SAMPLE * SAMPLE_CHARS`` characters of sample.

A word's features are computed in pieces of bounded size, so words of any length are taken whole.

Defined results: null texts and texts without a letter get ``und`` and score 0; ties go to the first language in
order; with no labelled row every document gets ``und``; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import per_text, sample_texts, through_texts

UNKNOWN = "und"
SAMPLE = 120
SAMPLE_CHARS = 8_000
#: Buckets of n-grams, and as many of words.
BUCKETS = 1 << 16
#: A row of weights for each bucket, and a last one that stays 0, for no feature.
ROWS = 2 * BUCKETS + 1
#: Characters of padded words whose features are held at once; a word of over a quarter of them is taken in pieces.
CELLS = 1 << 18
CHAIN = 128
#: Words whose probabilities are held at once.
BATCH_WORDS = 1 << 16


def word_features(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices of words, buckets): for words of like length at a time, their features; -1 where a word has none.

    A very long word comes in several pieces, each of which holds some of its features.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width, under = 16, -1
    while under < min(int(lengths.max(initial=0)), CELLS // 4):
        group = np.flatnonzero((lengths > under) & (lengths <= min(width, CELLS // 4)))
        for lo in range(0, len(group), max(1, CELLS // width)):
            at = group[lo : lo + max(1, CELLS // width)]
            padded = np.zeros((len(at), width + 4), np.uint64)
            joined = np.frombuffer(b"".join([words[i] for i in at]), np.uint8)
            own = lengths[at]
            rows = np.repeat(np.arange(len(at)), own)
            padded[rows, np.arange(len(joined)) - np.repeat(np.cumsum(own) - own, own) + 1] = joined
            padded[:, 0] = 256
            padded[np.arange(len(at)), own + 1] = 257
            whole = np.full(len(at), 7, np.uint64)
            for k in range(width + 1):
                whole = np.where(k <= own, whole * np.uint64(0x100000001B3) + padded[:, k], whole)
            yield at, np.concatenate([*grams(padded, own + 2, width + 2), BUCKETS + bucket(whole).astype(np.int64)[:, None]], axis=1)
        width, under = width * 2, width
    for i in np.flatnonzero(lengths > CELLS // 4):
        edged = np.zeros(lengths[i] + 4, np.uint64)
        edged[1:-3] = np.frombuffer(words[i], np.uint8)
        edged[0], edged[-3] = 256, 257
        for lo in range(0, len(edged) - 2, CELLS // 4):
            piece = edged[None, lo : lo + CELLS // 4 + 2]
            yield np.array([i]), np.concatenate(grams(piece, np.array([lengths[i] + 2 - lo]), piece.shape[1] - 2), axis=1)
        yield np.array([i]), np.array([[BUCKETS + zlib.crc32(words[i]) % BUCKETS]])


def grams(padded: np.ndarray, own: np.ndarray, width: int) -> list[np.ndarray]:
    """The buckets of the n-grams that begin at each of ``width`` places and end within the row's ``own`` characters."""
    found, place = [], np.arange(width)
    for n in (1, 2, 3):
        gram = np.full((len(padded), width), n, np.uint64)
        for k in range(n):
            gram = gram * np.uint64(1_000_003) + padded[:, k : k + width]
        found.append(np.where(place[None, :] + n <= own[:, None], bucket(gram).astype(np.int64), -1))
    return found


def bucket(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) % np.uint64(BUCKETS)


def has_letter(word: bytes) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word.decode())


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities (chains, words, languages) and expected transition counts; chains sorted longest first.

    scores: (chains, words, languages). Works on scaled probabilities, so long chains stay in range.
    """
    n, width, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(width)]
    alpha = np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        m = active[t]
        if not m:
            break
        a = (alpha[:m, t - 1] @ move) * emit[:m, t]
        alpha[:m, t] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(emit)
    pairs = np.zeros((k, k), np.float64)
    for t in range(width - 1, 0, -1):
        m = active[t]
        if not m:
            continue
        after = emit[:m, t] * beta[:m, t]
        b = after @ move.T
        joint = alpha[:m, t - 1].T @ (after / np.maximum((alpha[:m, t - 1] * b).sum(axis=1, keepdims=True), 1e-30))
        pairs += joint * move
        beta[:m, t - 1] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-30), pairs


class Crf:
    """Weights (buckets, languages) and transitions (languages, languages)."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.weights = np.zeros((ROWS, len(languages)), np.float32)
        self.transitions = np.zeros((len(languages), len(languages)), np.float32)

    def scores(self, words: list[bytes]) -> np.ndarray:
        found = np.zeros((len(words), len(self.languages)), np.float32)
        for lo in range(0, len(words), 1 << 12):
            for at, features in word_features(words[lo : lo + (1 << 12)]):
                found[lo + at] += self.weights[features].sum(axis=1)
        return found

    def fit(self, chains: list[tuple[list[bytes], np.ndarray]], epochs: int = 6, rate: float = 0.25, batch: int = 128, seed: int = 5) -> Crf:
        vocabulary = list(dict.fromkeys(w for words, _ in chains for w in words))
        index = {w: i for i, w in enumerate(vocabulary)}
        features = [(at, f) for at, f in word_features(vocabulary)]
        k, order = len(self.languages), np.random.default_rng(seed)
        squares, t_squares = np.full_like(self.weights, 1e-3), np.full_like(self.transitions, 1e-3)
        ids = [np.array([index[w] for w in words]) for words, _ in chains]
        for _ in range(epochs):
            shuffled = order.permutation(len(chains))
            for lo in range(0, len(chains), batch):
                own = sorted(shuffled[lo : lo + batch], key=lambda c: -len(ids[c]))
                lengths = np.array([len(ids[c]) for c in own])
                used, inverse = np.unique(np.concatenate([ids[c] for c in own]), return_inverse=True)
                table = np.zeros((len(vocabulary), k), np.float32)
                parts = []
                for at, f in features:
                    rows = np.flatnonzero(np.isin(at, used))
                    parts.append((at[rows], f[rows]))
                    table[at[rows]] += self.weights[f[rows]].sum(axis=1)
                mask = np.arange(lengths.max())[None, :] < lengths[:, None]
                scores = np.zeros((*mask.shape, k), np.float32)
                scores[mask] = table[used][inverse]
                p, pairs = forward_backward(scores, lengths, self.transitions)
                truth = np.concatenate([chains[c][1] for c in own])
                wrong = p[mask]
                wrong[np.arange(len(truth)), truth] -= 1
                per_word = np.zeros((len(vocabulary), k), np.float32)
                np.add.at(per_word, used[inverse], wrong)
                slope = np.zeros_like(self.weights)
                for at, f in parts:
                    for x in range(k):
                        slope[:, x] += np.bincount(f.ravel() % ROWS, np.repeat(per_word[at, x], f.shape[1]), ROWS).astype(np.float32)
                slope[-1] = 0
                seen = np.zeros((k, k))
                for c in own:
                    np.add.at(seen, (chains[c][1][:-1], chains[c][1][1:]), 1)
                slope, t_slope = slope / batch + 1e-5 * self.weights, (pairs - seen).astype(np.float32) / batch
                squares += slope**2
                t_squares += t_slope**2
                self.weights -= rate * slope / np.sqrt(squares)
                self.transitions -= rate * t_slope / np.sqrt(t_squares)
        return self

    def label(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Every word's probabilities for each language, document by document."""
        every = np.array([w for words in docs for w in words], dtype=object)
        codes, distinct = pd.factorize(every)
        table = self.scores(list(distinct))
        sizes = np.array([len(words) for words in docs])
        n_chains = -(-sizes // CHAIN)
        lengths = np.full(n_chains.sum(), CHAIN)
        ends = np.cumsum(n_chains)
        full = sizes > 0
        lengths[ends[full] - 1] = sizes[full] - (n_chains[full] - 1) * CHAIN
        order = np.argsort(-lengths, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        mask = np.arange(CHAIN)[None, :] < lengths[:, None]
        scores = np.zeros((len(lengths), CHAIN, table.shape[1]), np.float32)
        scores[mask] = table[codes]
        p, _ = forward_backward(scores[order], lengths[order], self.transitions)
        return np.split(p[place][mask], np.cumsum(sizes)[:-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for lo, hi in _runs([len(t or "") // 6 + 1 for t in texts]):
            docs = [tokens(t) if t else [] for t in texts[lo:hi]]
            if not self.languages:
                out += [(UNKNOWN, 0.0)] * len(docs)
                continue
            if not any(docs):
                out += [(UNKNOWN, 0.0)] * len(docs)
                continue
            for words, p in zip(docs, self._sums(docs), strict=True):
                total = p.sum()
                out.append((self.languages[int(p.argmax())], float(min(1.0, p.max() / total))) if total > 0 else (UNKNOWN, 0.0))
        return out

    def _sums(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Sums of the probabilities of each document's words with letters; a very long one is labelled in stretches."""
        stretch = BATCH_WORDS // CHAIN * CHAIN
        if len(docs) == 1 and len(docs[0]) > stretch:
            return [sum(self._sums([docs[0][a : a + stretch]])[0] for a in range(0, len(docs[0]), stretch))]
        letters: dict[bytes, bool] = {}
        found = []
        for words, p in zip(docs, self.label(docs), strict=True):
            own = []
            for w in words:
                if (x := letters.get(w)) is None:
                    x = letters[w] = has_letter(w)
                own.append(x)
            found.append(p[np.array(own, bool)].sum(axis=0, dtype=np.float64) if words else np.zeros(len(self.languages)))
        return found


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Slices of at most BATCH_WORDS in all, or one that is larger."""
    lo, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > BATCH_WORDS:
            yield lo, i
            lo, held = i, 0
        held += size
    if sizes:
        yield lo, len(sizes)


def chains_of(texts: list[tuple[str, int]], seed: int = 3) -> list[tuple[list[bytes], np.ndarray]]:
    """Training chains: stretches of one document, and as many that splice runs of two languages."""
    rng = np.random.default_rng(seed)
    plain = []
    for text, label in texts:
        words = [w for w in tokens(text) if has_letter(w)]
        for a in range(0, len(words), 48):
            plain.append((words[a : a + 48], np.full(len(words[a : a + 48]), label)))
    mixed = []
    for a, b in zip(rng.permutation(len(plain)), rng.permutation(len(plain)), strict=True):
        cut, other = int(rng.integers(4, 44)), int(rng.integers(4, 44))
        mixed.append((plain[a][0][:cut] + plain[b][0][:other], np.concatenate([plain[a][1][:cut], plain[b][1][:other]])))
    return plain + mixed


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Crf:
    """Fit on at most ``sample`` distinct texts per language and ``sample_chars`` characters of each."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("by"), F.col(text_col).alias("text")).where("by IS NOT NULL AND text IS NOT NULL")
    held = sample_texts(rows, sample, sample_chars)
    languages = sorted(held)
    return Crf(languages).fit(chains_of([(t, i) for i, lang in enumerate(languages) for t in held[lang]])) if languages else Crf([])


def identify(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row."""
    model = docs.sparkSession.sparkContext.broadcast((crf.languages, crf.weights, crf.transitions))

    def of():
        own = Crf([])
        own.languages, own.weights, own.transitions = model.value

        def predict(texts: list[str | None]):
            found = own.predict(texts)
            return None, [[x for x, _ in found], [s for _, s in found]]

        return predict

    return per_text(docs, [id_col], F.col(text_col), [("lang_pred", pa.string()), ("score", pa.float64())], of)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is known with at least ``least`` of the words' probability; the columns of docs."""
    crf = train(docs.where(~held_out(F.col("doc_id"))))
    model = docs.sparkSession.sparkContext.broadcast((crf.languages, crf.weights, crf.transitions))

    def of():
        own = Crf([])
        own.languages, own.weights, own.transitions = model.value
        return lambda texts: ([x >= least for _, x in own.predict([t or None for t in texts])], None)

    return through_texts(docs, "text", of)


def query(docs: DataFrame) -> DataFrame:
    crf = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs, crf)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
