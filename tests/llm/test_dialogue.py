import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvia.llm import dialogue as D

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def faults(turns):
    seen, found = set(), []
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        found.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(turns):
    """Every way to edit the turns, with up to two inserts at each place."""
    own, best = faults(turns), None
    gaps = ["", "u", "a", "ua", "au"]
    choices = []
    for (_, role, text), fault in zip(turns, own, strict=True):
        one = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            one += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        choices.append(one)
    for picked in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            rows, cost, audit = [], 0, ""
            for gap, edit in itertools.zip_longest(inserts, picked):
                rows += [("user" if g == "u" else "assistant", "") for g in gap]
                cost, audit = cost + 3 * len(gap), audit + "I" * len(gap)
                if edit:
                    audit, cost = audit + edit[0], cost + edit[1]
                    rows += [edit[2]] if edit[2] else []
            if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in rows)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, rows
    return best


def expect(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    own = faults(turns)
    known = {t for t, _, _ in turns if t is not None}
    roles = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    cost, audit, rows = cheapest(turns)
    text = "\n".join(f"{r}:{t}" for r, t in rows)
    return (max(known) - min(known) + 1 - len(known) if known else 0, own.count("blank"), own.count("duplicate"), own.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def made(rng, n):
    roles, texts = ["system", "user", "assistant", "tool", "", "user"], ["Yes.", "No", " ", "", "Why?", "Well!  ", "und so"]
    return [(rng.choice([None, 0, 1, 2, 3, 5]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def values(df):
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


@pytest.mark.parametrize("longest", [D.LONGEST, 1])
def test_against_every_edit(spark, longest):
    """Also with every conversation taken as a long one, in ranges over several tasks."""
    rng = random.Random(4)
    rows = {(None if k == 0 else k): made(rng, rng.choice([1, 2, 3, 3, 3])) for k in range(90)}
    df = spark.createDataFrame([(k, *t) for k, own in rows.items() for t in own], SCHEMA).repartition(3)
    assert values(D.assess_all(df, longest)) == {k: expect(own) for k, own in rows.items()}


def test_long_conversations_in_ranges(spark):
    rng = random.Random(6)
    rows = [(k, t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", "No", "", f"W{rng.random()}.", f"w{rng.random()}"])) for k in range(6) for t in range(rng.choice([3, 300, 2500])) for _ in range(rng.choice([1, 1, 3]))]
    df = spark.createDataFrame(rows, SCHEMA)
    short, long = values(D.assess_all(df)), values(D.assess_all(df, 50))
    assert short == long and len(short) == 6
    turns = D.repaired_turns(df, D.assess_all(df, 50)).orderBy("conv_id", "at").collect()
    for k in short:
        own = [r for r in turns if r["conv_id"] == k]
        assert GRAMMAR.fullmatch("".join(r["role"][0] for r in own)) and [r["at"] for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own).encode()).hexdigest() == short[k][-1]


def test_shared_letters_and_dropped_states_change_nothing():
    rng = random.Random(9)
    for _ in range(300):
        turns = [(rng.choice("suuaat"), rng.choice([D.SOUND, D.SOUND, D.BLANK, D.DUPLICATE, D.TRUNCATED])) for _ in range(rng.randint(0, 150))]
        path, layer = D.Path(D.START), D.close({D.START: (0, "")})
        for role, fault in turns:
            path.turn(role, fault)
            layer = D.close(D.step(layer, role, fault))
        assert path.to() == min(layer[s] for s in (D.START, D.ASSISTANT) if s in layer)


def hurt(rows):
    found = {}
    for conv, turn, role, text in rows:
        found.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub(r"[.!?]", "", text) if lot == 2 else text
        found[conv] += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return found


def test_query_on_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k if k % 40 else None, rng.choice([None, 0, 1, 2, 3, 9007199254740993]), rng.choice([None, "user", "assistant", "system", "tool"]), rng.choice([None, "", "Yes. No!", "Well", "é\n漢. "])) for k in range(160) for _ in range(rng.choice([1, 1, 2]))]
    rows += [(500, t, "user", f"word {t}. " * 20_000) for t in range(2)]
    rows = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][:2]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "n", "lot", "copy", "at", "own", "part", "audit", "cost")})
    want = {k: expect(own) for k, own in hurt(rows).items()}
    assert values(D.query(df)) == want
    assert any(w[-1] == EMPTY and w[-2] == "" for w in want.values())
    assert D.query(df.limit(0)).count() == 0


def test_query_over_stored_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    got = values(D.query(df))
    for conv, own in hurt([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items():
        if len(own) <= 3:
            assert got.pop(conv) == expect(own)
        else:
            assert got[conv][:5] == expect_counts(own) and len(got[conv][6].replace("I", "")) == len(own)


def expect_counts(turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    own, known, roles = faults(turns), {t for t, _, _ in turns if t is not None}, [r[:1] for _, r, _ in turns]
    return (max(known) - min(known) + 1 - len(known) if known else 0, own.count("blank"), own.count("duplicate"), own.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)))
