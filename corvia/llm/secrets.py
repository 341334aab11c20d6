"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

First-order Markov models over characters are trained from labelled samples: one for random strings of each alphabet
that keys use (hexadecimal, base 32, base 62, base 64, letters alone; drawn with a fixed seed), and one for ordinary
identifiers. These are names that the standard library's modules define, words of public tokenizers' vocabularies and of
the corpus, alone and joined as identifiers, constants, paths and package names are, with numbers, and dates, times and
numbers themselves. A run of at least ``MIN_RUN`` key characters is a secret if the best of the random models explains it
better than the ordinary one by more than a threshold (in the logarithm, over the whole run). The threshold is fitted
too: every fourth ordinary sample is kept back, and one in ``RATE`` of these may be over it, less a margin. Of a run that
a pattern's match covers in part, each part outside the matches is judged like a run of its own. The patterns stand
beside it as a base. Strings of digits alone are taken for numbers.

The identifier sample is bounded: of the corpus at most ``SAMPLE_DOCS`` distinct texts, the first by hash, and of each a
stretch of at most ``SAMPLE_CHARS`` characters; only the model is fitted on it, every whole text is scanned.

Defined results: null and empty texts have no spans; ties of start go by the order of ``KINDS``; repeated rows stay;
other columns are ignored (scan) or carried along (redact).
"""

from __future__ import annotations

import base64
import importlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import per_text, sample_texts, through_texts
from corvia.llm.packing import tokenizer_file

# The kinds and patterns of the base.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

MIN_RUN = 12
#: Ordinary samples kept back of which one may be over the threshold; what is added to it, and the least that it is.
RATE, MARGIN, LEAST = 3_000, 1.0, 12.0
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
#: Words of the corpus, of vocabularies, and joined names in the sample of identifiers, at most.
SAMPLE_WORDS, SAMPLE_JOINED = 60_000, 40_000
#: Vocabularies whose words are ordinary.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: Modules of the standard library whose names, and those of their classes, are ordinary.
MODULES = (
    "argparse", "ast", "asyncio", "calendar", "codecs", "collections", "concurrent.futures", "configparser", "ctypes", "datetime", "decimal", "difflib", "dis", "email.message", "email.policy", "ftplib", "http.client",
    "http.cookiejar", "http.server", "imaplib", "inspect", "json", "locale", "logging.handlers", "multiprocessing.pool", "optparse", "os", "re", "shutil", "smtplib", "socket", "socketserver", "sqlite3", "ssl", "subprocess",
    "sys", "tarfile", "tempfile", "threading", "unittest.mock", "urllib.parse", "urllib.request", "xml.dom.minidom", "xml.etree.ElementTree", "xml.sax.handler", "xmlrpc.client", "zipfile",
)
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
#: Cheap marks of which every match of ASSIGN has one.
CUE = re.compile(r"(?ai)passw|secret|token|api_?key")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, leftmost and without overlap within a kind; those that are too short are dropped."""
    found = []
    if CUE.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class MarkovPair:
    """Log-likelihood ratios of transitions between ASCII characters: one table for each kind of random string, against
    identifiers; and how much a run's best sum of them must be to make it a secret."""

    def __init__(self, ratios: np.ndarray, threshold: float):
        self.ratios, self.threshold = ratios, threshold

    @classmethod
    def fit(cls, secrets: list[list[str]], identifiers: list[str], smooth: float = 0.5) -> MarkovPair:
        def log_p(samples: list[str]) -> np.ndarray:
            counts = np.full((128, 128), smooth / 64)
            for s in samples:
                codes = np.frombuffer(("\x02" + s).encode("ascii", "ignore"), np.uint8)
                np.add.at(counts, (codes[:-1], codes[1:]), 1)
            return np.log(counts / counts.sum(axis=1, keepdims=True))

        ordinary = log_p([s for i, s in enumerate(identifiers) if i % 4])
        pair = cls(np.stack([log_p(s) - ordinary for s in secrets]).astype(np.float32), LEAST)
        kept_back = [pair.score(s) for s in identifiers[::4] if len(s) >= MIN_RUN and s.isascii()]
        if kept_back:
            pair.threshold = max(LEAST, float(np.quantile(kept_back, 1 - 1 / RATE)) + MARGIN)
        return pair

    def score(self, run: str) -> float:
        codes = np.frombuffer(("\x02" + run).encode("ascii"), np.uint8)
        return float(self.ratios[:, codes[:-1], codes[1:]].sum(axis=1, dtype=np.float64).max())


def random_strings(n: int = 1500, seed: int = 11) -> list[list[str]]:
    """Samples of each alphabet."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = [digits + "abcdef", digits + "ABCDEF", upper + "234567", lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", lower + digits, upper + digits, lower + upper, lower, upper]
    return [["".join(rng.choices(a, k=rng.randint(16, 64))) for _ in range(n)] for a in alphabets]


def library_names() -> list[str]:
    """Names that modules of the standard library give to others, and those that their classes define: what else a module
    holds depends on what a process has loaded."""
    found: set[str] = set()
    for module in map(importlib.import_module, MODULES):
        for name in getattr(module, "__all__", ()):
            value = getattr(module, name, None)
            found |= {name, *(vars(value) if isinstance(value, type) else ())}
    return sorted({n.strip("_") for n in found if n.isidentifier() and n.isascii() and len(n.strip("_")) > 2})


def vocabulary_words(paths: list[str]) -> list[str]:
    """Whole words of files of ranks (base64, rank): tokens of a space and letters."""
    found = []
    for path in paths:
        with open(path, "rb") as f:
            for raw in f:
                token = base64.b64decode(raw.split()[0])
                if len(token) > 3 and token[:1] == b" " and token[1:].isalpha():
                    found.append(token[1:].decode("ascii"))
    return found


def joined_names(rng: random.Random, words: list[str], n: int) -> list[str]:
    """Two to five words as names are made of them, every fifth with a number."""
    title = lambda w: "".join(x[:1].upper() + x[1:] for x in w)
    forms = [lambda w: "_".join(w).lower(), lambda w: "-".join(w).lower(), title, lambda w: "/".join(w), lambda w: "_".join(w).upper(), lambda w: w[0].lower() + title(w[1:]), lambda w: "".join(w).lower()]
    found = []
    for i in range(n):
        name = forms[i % len(forms)](rng.choices(words, k=rng.randint(2, 5)))
        found.append(name + (rng.choice(("", "_", "-")) + str(rng.randint(0, 99_999)) if i % 5 == 0 else ""))
    return found


def identifiers(texts: list[str], words: list[str] = (), seed: int = 12) -> list[str]:
    """Ordinary runs: words of the texts outside the base's matches, other words, library names, all of them joined too,
    and dates, times, numbers and rules."""
    rng, own = random.Random(seed), []
    for text in texts:
        for _, a, b in reversed(base_spans(text)):
            text = text[:a] + " " + text[b:]
        own += [w for w in re.findall(r"[A-Za-z][A-Za-z0-9]*", text) if sum(c.isdigit() for c in w) <= 2]
    names, words = library_names(), rng.sample(list(words), min(len(words), SAMPLE_WORDS))
    own = rng.choices(own, k=min(SAMPLE_WORDS, 4 * len(own))) if own else []
    joined = joined_names(rng, [*words, *names] or names, SAMPLE_JOINED // 2) + joined_names(rng, own or names, SAMPLE_JOINED // 2)
    day = lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    hour = lambda by: by.join(f"{rng.randint(0, 59):02d}" for _ in range(3))
    times = [day() + x for _ in range(300) for x in ("", f"T{hour('-')}Z", f"_{hour('-')}", f"T{hour('')}", f"-{hour('')}")]
    numbers = [str(rng.randint(10**9, 10 ** rng.randint(10, 40))) for _ in range(1500)]
    rules = [c * rng.randint(12, 60) for c in "-=_+/" for _ in range(20)]
    found = own + words + names * 3 + joined + times + numbers + rules
    rng.shuffle(found)
    return found


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, vocabularies: tuple[str, ...] | None = None) -> MarkovPair:
    """Fit the pair on random strings and on ordinary names, among them the words of at most sample_docs distinct texts.
    ``vocabularies``: paths of files of ranks whose words are ordinary too (those of the public tokenizers)."""
    paths = [tokenizer_file(name) for name in VOCABULARIES] if vocabularies is None else list(vocabularies)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.lit("").alias("by"), F.col(text_col).alias("text"))
    return MarkovPair.fit(random_strings(), identifiers(sample_texts(rows, sample_docs, sample_chars).get("", []), vocabulary_words(paths)))


def is_random(run: str, pair: MarkovPair) -> bool:
    """Whether the models' verdict on a run is a secret."""
    return pair.score(run) > pair.threshold


def _outside(runs: Iterator[tuple[int, int]], base: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of the runs outside the spans, in order; both are given by start, so one pass over each will do."""
    covered: list[list[int]] = []
    for _, s, e in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    at = 0
    for a, b in runs:
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        while at < len(covered) and covered[at][0] < b:
            if a < covered[at][0]:
                yield a, covered[at][0]
            a = covered[at][1]
            if a >= b:
                break
            at += 1
        if a < b:
            yield a, b


def all_spans(text: str, pair: MarkovPair) -> tuple[list[Span], list[Span]]:
    """The base's spans, and those with the models' spans among them."""
    base = base_spans(text)
    parts = _outside((m.span() for m in RUN.finditer(text)), base)
    added = [("markov", a, b) for a, b in parts if b - a >= MIN_RUN and is_random(text[a:b], pair)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, pair: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base, spans): the base's spans and all spans, as kind:start:end."""

    def of():
        def scanned(texts: list[str | None]):
            found = [all_spans(t or "", pair) for t in texts]
            counts = [[sum(s[0] == k for s in spans) for _, spans in found] for k in KINDS]
            return None, [*counts, [joined(base) for base, _ in found], [joined(spans) for _, spans in found]]

        return scanned

    fields = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base", pa.string()), ("spans", pa.string())]
    return per_text(docs, [id_col], F.col(text_col), fields, of)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, pair: MarkovPair, text_col: str = "text") -> DataFrame:
    """Every row, with a mark in place of each secret and n_chars (if there is such a column) counted anew."""

    def of():
        return lambda texts: (None, [t if t is None else redacted(t, all_spans(t, pair)[1]) for t in texts])

    found = through_texts(docs, text_col, of)
    return found.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else found


def query(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
