"""Fill-in-the-middle: texts cut into prefix, middle and suffix, which are put in another order between marks.

Cuts are counted in code points, texts are stored in UTF-8. A text is kept as runs of its characters' classes (how many
bytes a character takes), each run with the number of characters before it: the run that holds a cut is found by binary
search, and the byte is the run's first one plus the characters into the run times their width. No text is decoded and
no character visited by Python; the runs of many texts are made and searched at once.

Defined results: a null text is the empty one, which stays plain, as does a text that holds a mark; the text is whole
whatever its length; equal rows give equal results. Everything is an expression of columns, so other columns, whatever
their names, are untouched. A null id is hashed as the empty string. Bytes that are no UTF-8 belong to the character
before them (the first one to itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvia.llm.common import release

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many are cut, and of 100 cut ones, how many begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
SEED = 1
#: Bytes of texts whose runs are held at once; a longer text is held alone.
CHUNK = 1 << 22

RESULT = "form string, output string, n long, prefix_chars long, middle_chars long"


class Runs:
    """Runs of characters that take equally many bytes, over texts that lie one after another."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        lead = (data & 0xC0) != 0x80
        lead[starts[starts < len(data)]] = True
        leads = np.flatnonzero(lead)
        widths = np.diff(leads, append=len(data))
        self.first_units = np.searchsorted(leads, starts)  # of each text
        opens = np.ones(len(leads), bool)
        opens[1:] = widths[1:] != widths[:-1]
        opens[self.first_units[self.first_units < len(leads)]] = True
        heads = np.flatnonzero(opens)
        # One more run, of no width, is where the last text ends.
        self.units = np.append(heads, len(leads))
        self.bytes = np.append(leads[heads], len(data))
        self.widths = np.append(widths[heads], 0)

    def byte_of(self, units: np.ndarray) -> np.ndarray:
        """Where the characters of these numbers begin."""
        run = np.searchsorted(self.units, units, "right") - 1
        return self.bytes[run] + (units - self.units[run]) * self.widths[run]


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of the array with at most so many bytes, or one text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + limit, "right")) - 1)
        yield at, min(to, len(texts))
        at = to


def _cut(texts: pa.Array, hashes: pa.Array, cut: int, suffix_first: int, marks: tuple[str, ...]) -> pa.Array:
    raw = texts.buffers()[2]
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    base, ends = int(ends[0]), ends - ends[0]
    data = np.frombuffer(raw, np.uint8)[base : base + int(ends[-1])] if raw else np.zeros(0, np.uint8)
    runs = Runs(data, ends)
    n, h = np.diff(runs.first_units), np.array([[int(x[i : i + 8], 16) for i in (0, 8, 16, 24)] for x in hashes.to_pylist()], np.int64)
    lo, hi = np.sort([h[:, 0] % (n + 1), h[:, 1] % (n + 1)], axis=0)
    marked = np.zeros(len(texts), bool)
    for mark in marks:
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= cut)
    spm = ~plain & (h[:, 3] % 100 < suffix_first)
    at_lo, at_hi = runs.byte_of(runs.first_units[:-1] + lo), runs.byte_of(runs.first_units[:-1] + hi)
    whole, (p, s, m) = data.tobytes(), (x.encode() for x in marks)
    parts: list[bytes] = []
    for is_plain, is_spm, a, b, c, d in zip(plain.tolist(), spm.tolist(), ends[:-1].tolist(), at_lo.tolist(), at_hi.tolist(), ends[1:].tolist(), strict=True):
        if is_plain:
            parts.append(whole[a:d])
        elif is_spm:
            parts += (s, whole[c:d], p, whole[a:b], m, whole[b:c])
        else:
            parts += (p, whole[a:b], s, whole[c:d], m, whole[b:c])
    sizes = np.diff(ends) + np.where(plain, 0, len(p) + len(s) + len(m))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    output = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(parts))])
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    columns = [form, output, pa.array(n, pa.int64()), pa.array(lo, pa.int64(), mask=plain), pa.array(hi - lo, pa.int64(), mask=plain)]
    return pa.StructArray.from_arrays(columns, ["form", "output", "n", "prefix_chars", "middle_chars"])


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be found again: each begins with a character that none of them has elsewhere, none begins another.

    A mark can then not begin within a text and end in a mark, so a cut text holds each mark once.
    """
    if len(marks) != 3 or not all(marks) or any(m[0] in x[1:] for m in marks for x in marks) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError(f"marks can't be told apart: {marks}")


def transform(text: Column, hashes: Column, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> Column:
    """A struct of form, output, n (code points), prefix_chars and middle_chars (null if plain).

    ``hashes`` is hexadecimal; its first four groups of eight digits decide on both cuts, on cutting at all and on the
    order, so that reruns agree. The prefix ends at the smaller cut, the middle at the larger one.
    """
    check_marks(marks)

    @F.arrow_udf(RESULT)
    def cut_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, own in batches:
            made = [_cut(texts[a:b], own[a:b], cut, suffix_first, marks) for a, b in slices(texts, CHUNK)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.struct([("form", pa.string()), ("output", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]))
        release()

    return cut_texts(F.coalesce(text, F.lit("")), hashes)


def id_hash(key: Column, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of the form was made from."""
    p, s, m = marks

    def between(begins: str, ends: str) -> Column:
        return F.substring_index(F.substring_index(output, begins, -1), ends, 1)

    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    made = docs.select("doc_id", transform(F.col("text"), id_hash(F.col("doc_id"))).alias("fim"))
    digests = {"output_sha256": F.sha2("fim.output", 256), "restored_sha256": F.sha2(restore(F.col("fim.output"), F.col("fim.form")), 256)}
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", *[c.alias(name) for name, c in digests.items()])


#: The twin cuts by substring over characters, and rebuilds by the places of the marks.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, length(text) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || substr(text, 1, lo) || '<S>' || substr(text, hi + 1) || '<M>' || substr(text, lo + 1, hi - lo)
    ELSE '<S>' || substr(text, hi + 1) || '<P>' || substr(text, 1, lo) || '<M>' || substr(text, lo + 1, hi - lo) END AS output FROM c),
r AS (SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3)
      || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
    ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3)
      || substr(output, 4, strpos(output, '<P>') - 4) END AS restored FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
  sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM r
"""
