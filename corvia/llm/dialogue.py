"""Repair of conversations whose turns are damaged: the cheapest edits that make the roles follow a grammar.

Roles (by their first letters) must spell ``(s?(ua)+)?``. A forward Viterbi pass over the four states of that grammar
carries, for each state, the least (cost, audit): audits are the edits' letters in order, K(eep), R(erole), D(elete) and
I(nsert), and of equal costs the one that comes first in ASCII counts. Each turn's layer is closed by at most two
inserts: three never beat one. Two audits of one layer and equal cost are never beginnings of each other (they have as
many K, R and D, and so as many I), so the smaller one stays smaller whatever follows. A state that costs more than
another from which all its endings can be reached is dropped, and letters that all states share are put aside, so a
long conversation holds short strings.

A conversation of at most LONGEST turns and BYTES bytes is a group in one task. Longer ones are never gathered: equal turns are counted
into one, the rest is sorted into ranges of rows over many tasks, each range gives the least (cost, audit) from every
state to every state over narrow columns, and ranges are chained. The texts of a long conversation then pass through one
task for their hash, which is a chain by nature, one row at a time.

Defined results: turns are taken in the order of turn (nulls first), role, text; equal rows are repeats. A null role or
text must be filled before (``filled``). Rows with a null conversation are one conversation. A role that begins with
none of s, u, a can't be kept, nor can an empty one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvia.llm.common import durable

#: Turns and bytes of the longest conversation that is one group.
LONGEST, BYTES = 4096, 1 << 24
BLANKS = " \t\n\x0b\x0c\r"
#: A turn's first fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3

#: States: nothing yet, after s, after u, after a; where a role's letter leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
ROWS = 4096

Layer = dict[int, tuple[int, str]]


def _offer(layer: Layer, state: int, cost: int, audit: str) -> None:
    held = layer.get(state)
    if held is None or (cost, audit) < held:
        layer[state] = cost, audit


def close(layer: Layer) -> Layer:
    """The layer after no, one or two inserts."""
    for _ in range(2):
        for state, (cost, audit) in list(layer.items()):
            for role in "ua":
                if (to := LEADS[role].get(state)) is not None:
                    _offer(layer, to, cost + INSERT, audit + "I")
    return layer


def step(layer: Layer, role: str, fault: int) -> Layer:
    """The layer after one more turn, before inserts."""
    found: Layer = {}
    for state, (cost, audit) in layer.items():
        _offer(found, state, cost + DELETE, audit + "D")
        if fault in (SOUND, TRUNCATED):
            own = cost + (CUT_SHORT if fault == TRUNCATED else 0)
            if (to := LEADS.get(role, {}).get(state)) is not None:
                _offer(found, to, own, audit + "K")
            for other in "ua":
                if (to := LEADS[other].get(state)) is not None:
                    _offer(found, to, own + REROLE, audit + "R")
    return found


def prune(layer: Layer) -> Layer:
    """Without states that cost more than reaching all they can from ``a`` does: from ``s``, the same roles follow, and
    from the start also an ``s``, which can be deleted instead."""
    if held := layer.get(ASSISTANT):
        for state, more in ((SYSTEM, 0), (START, DELETE)):
            if state in layer and layer[state][0] > held[0] + more:
                del layer[state]
    return layer


class Path:
    """A forward pass from one state; letters that all its states share are put aside."""

    def __init__(self, start: int):
        self.layer: Layer = close({start: (0, "")})
        self.shared: list[str] = []

    def turn(self, role: str, fault: int, again: int = 0, then: int = DUPLICATE) -> None:
        """One turn and ``again`` repeats of it, whose fault is ``then``: they can only be deleted, and an insert between
        them never comes before one after them."""
        self.layer = step(self.layer, role, fault)
        if again:
            close(self.layer)
            self.layer = {s: (c + DELETE * again, a + "D" * again) for s, (c, a) in self.layer.items()}
        self.settle()

    def settle(self) -> None:
        prune(close(self.layer))
        if len(next(iter(self.layer.values()))[1]) > 64 and (common := os.path.commonprefix([a for _, a in self.layer.values()])):
            self.shared.append(common)
            self.layer = {s: (c, a[len(common) :]) for s, (c, a) in self.layer.items()}

    def to(self, states: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str]:
        cost, audit = min(self.layer[s] for s in states if s in self.layer)
        return cost, "".join(self.shared) + audit


def repaired(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the conversation after the edits, as its turns pass by."""
    state = START
    for letter in audit:
        if letter == "I":
            yield _made(state, "")
            state = _next(state)
            continue
        role, text = next(turns)
        if letter == "K":
            yield role, text
            state = LEADS[role[0]][state]
        elif letter == "R":
            yield _made(state, text)
            state = _next(state)


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _made(state: int, text: str) -> tuple[str, str]:
    return ("assistant" if state == USER else "user"), text


def fault_of(text: str) -> int:
    last = text.rstrip(BLANKS)[-1:]
    return BLANK if not last else SOUND if last in ".!?" else TRUNCATED


KINDS = [("turns", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
FIELDS = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in KINDS)


def digest(turns: Iterator[tuple[str, str]]) -> str:
    """SHA-256 of the turns as ``role:text``, joined by newlines; one turn is held at a time."""
    state, between = hashlib.sha256(), b""
    for role, text in turns:
        state.update(between + f"{role}:{text}".encode())
        between = b"\n"
    return state.hexdigest()


def assess(turns: list[tuple[int | None, str, str]]) -> tuple:
    """The fields of one conversation's turns, which are in order."""
    counts, seen, illegal, before, path = [0, 0, 0, 0], set(), 0, None, Path(START)
    for _, role, text in turns:
        fault = fault_of(text)
        if fault != BLANK and (role, text) in seen:
            fault = DUPLICATE
        seen.add((role, text))
        counts[fault] += 1
        illegal += before is not None and before + role[:1] not in LEGAL
        before = role[:1]
        path.turn(before, fault)
    own = {t for t, _, _ in turns if t is not None}
    cost, audit = path.to()
    gaps = max(own) - min(own) + 1 - len(own) if own else 0
    return len(turns), gaps, *counts[1:], illegal, cost, audit, digest(repaired((t[1:] for t in turns), audit))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Each conversation's turns from sorted rows."""
    key, own = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own and row[0] != key:
                yield key, own
                own = []
            key = row[0]
            own.append(row[1:])
    if own:
        yield key, own


def _schema(df: DataFrame, *keys: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys])


def _short(turns: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        kinds: list[pa.DataType] = []

        def known():
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield batch

        def made() -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*held, strict=True), [kinds[0], *(k for _, k in KINDS)], strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *(n for n, _ in KINDS)])

        for key, own in _conversations(known()):
            held.append((key, *assess(own)))
            if len(held) >= ROWS:
                yield made()
                held.clear()
        if held:
            yield made()

    schema = _schema(turns, "conv_id")
    for part in T.StructType.fromDDL(FIELDS):
        schema = schema.add(part)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


PATHS = pa.list_(pa.field("element", pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))


def _ranges(table: pa.Table) -> pa.Table:
    """One range of one conversation: the least (cost, audit) from every state to every state, and its counts."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("at", "n", "initial", "fault", "dup")), strict=True))
    paths, counts, illegal, before = [Path(s) for s in range(4)], [0, 0, 0, 0], 0, None
    for _, n, initial, fault, dup in rows:
        first, then = (DUPLICATE if dup and fault != BLANK else fault), (BLANK if fault == BLANK else DUPLICATE)
        counts[first] += 1
        counts[then] += n - 1
        illegal += (before is not None and before + initial not in LEGAL) + (n - 1)
        before = initial
        for path in paths:
            path.turn(initial, first, n - 1)
    found = [{"start": s, "end": e, "cost": c, "audit": "".join(p.shared) + a} for s, p in enumerate(paths) for e, (c, a) in p.layer.items()]
    made = {
        "key": table.column("key").slice(0, 1), "part": table.column("part").slice(0, 1), "n": [sum(r[1] for r in rows)], "blank": [counts[BLANK]], "duplicate": [counts[DUPLICATE]],
        "truncated": [counts[TRUNCATED]], "illegal": [illegal], "first": [rows[0][2]], "last": [before], "paths": pa.array([found], PATHS),
    }
    return pa.table(made)


def _chain(table: pa.Table) -> pa.Table:
    """One conversation's ranges, one after another."""
    ranges = sorted(table.to_pylist(), key=lambda r: r["part"])
    layer, shared, illegal, before = {START: (0, "")}, [], 0, None
    for r in ranges:
        illegal += r["illegal"] + (before is not None and before + r["first"] not in LEGAL)
        before = r["last"]
        found: Layer = {}
        for p in r["paths"]:
            if p["start"] in layer:
                cost, audit = layer[p["start"]]
                _offer(found, p["end"], cost + p["cost"], audit + p["audit"])
        common = os.path.commonprefix([a for _, a in found.values()])
        shared.append(common)
        layer = {s: (c, a[len(common) :]) for s, (c, a) in found.items()}
    cost, audit = min(layer[s] for s in (START, ASSISTANT) if s in layer)
    sums = {k: [sum(r[k] for r in ranges)] for k in ("n", "blank", "duplicate", "truncated")}
    return pa.table({"key": table.column("key").slice(0, 1), **sums, "illegal": [illegal], "cost": [cost], "audit": ["".join(shared) + audit]})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of long conversations: the audit comes first, then the turns pass by, a batch at a time."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(rows, None)

    def turns():
        nonlocal row
        while (row := next(rows, None)) and row[1] >= 0:
            for _ in range(row[2]):
                yield row[3], row[4]

    while row is not None:
        key, audit = row[0], row[4]
        own = turns()
        found = digest(repaired(own, audit))
        for _ in own:  # deletions may end the audit, so the turns are used up; a shorter one would be an error
            raise RuntimeError("an audit leaves turns over")
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([found])], ["key", "repaired_sha256"])


def _long(turns: DataFrame) -> DataFrame:
    """The fields of conversations (key, turn, role, text) of any length."""
    equal = turns.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    rows = equal.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = durable(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    narrow = rows.select("key", "part", "at", "n", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256).alias("same"))
    narrow = durable(narrow)
    firsts = narrow.groupBy("key", "same").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("dup"))
    marked = narrow.join(firsts, "at", "left").withColumn("dup", F.coalesce("dup", F.lit(True)))
    path = "array<struct<start: int, end: int, cost: long, audit: string>>"
    ranges = marked.groupBy("key", "part").applyInArrow(_ranges, f"key long, part int, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, paths {path}")
    whole = durable(ranges.groupBy("key").applyInArrow(_chain, "key long, n long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))
    gaps = narrow.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    heads = whole.select("key", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit("").alias("role"), F.col("audit").alias("text"))
    passing = heads.unionByName(rows.select("key", "at", "n", "role", "text")).repartition("key").sortWithinPartitions("key", "at")
    hashes = passing.mapInArrow(_digests, "key long, repaired_sha256 string")
    return whole.withColumnRenamed("n", "turns").join(gaps, "key").join(hashes, "key")


def assess_all(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per conversation of (conv_id, turn long, role, text): turns, gaps in their numbers, first faults by kind, adjacent
    roles that may not be, the least cost, its audit, and the SHA-256 of the repaired turns. ``turns`` is read three times."""
    fields = ["conv_id", *(name for name, _ in KINDS)]
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    many = (F.col("n") > longest) | ((F.col("n") > 1) & (F.col("bytes") > BYTES))
    long = durable(sizes.where(many).select(F.col("conv_id").alias("own"), F.monotonically_increasing_id().alias("key")))
    if long.isEmpty():
        return _short(turns.select("conv_id", "turn", "role", "text")).select(*fields)
    same = F.col("conv_id").eqNullSafe(F.col("own"))
    rest = turns.select("conv_id", "turn", "role", "text").join(long, same, "left_anti")
    found = _long(turns.join(long, same).select("key", "turn", "role", "text")).join(long, "key").withColumnRenamed("own", "conv_id")
    return _short(rest).select(*fields).unionByName(found.select(*fields))


def repaired_turns(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows (conv_id, at, role, text) of all repaired conversations, for verdicts of ``assess_all``; turns with their audit
    are sorted by conversation and pass by a batch at a time."""
    order = ["conv_id", "head", F.col("turn").asc_nulls_first(), "role", "text"]
    heads = verdicts.select("conv_id", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = heads.unionByName(turns.select("conv_id", F.lit(1).alias("head"), F.col("turn").cast("long").alias("turn"), "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def passing():
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        rows, made = passing(), []
        row = next(rows, None)

        def turns():
            nonlocal row
            while (row := next(rows, None)) and row[1]:
                yield row[3], row[4]

        def flush() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True))
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kinds[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3])], ["conv_id", "at", "role", "text"])

        while row is not None:
            key, own = row[0], turns()
            for at, (role, text) in enumerate(repaired(own, row[4])):
                made.append((key, at, role, text))
                if len(made) >= ROWS:
                    yield flush()
            for _ in own:
                raise RuntimeError("an audit leaves turns over")
        if made:
            yield flush()

    schema = _schema(turns, "conv_id").add("at", "long").add("role", "string").add("text", "string")
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def filled(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage: a hash of ``conv_id:turn`` drops, empties, cuts short, repeats or re-roles a turn, or leaves it."""
    lot = F.crc32(F.concat(filled(F.col("conv_id")), F.lit(":"), filled(F.col("turn")))) % 20
    text, role = filled(F.col("text")), filled(F.col("role"))
    hurt = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), lot.alias("lot"), F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("lot <> 0")
    times = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hurt.withColumn("copy", F.explode(times)).select("conv_id", "turn", "role", "text")


def query(conversations: DataFrame) -> DataFrame:
    found = assess_all(damaged(conversations)).withColumnRenamed("conv_id", "own")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left")
    longs = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
