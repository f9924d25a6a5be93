"""Conversation repair against a brute-force version of the contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from llm_helpers import SF
from sentimart.llm import conversations as C

LINE = re.compile("(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(codes):
    """``(cost, audit)`` by a plain recurrence from the back over all edits."""
    @lru_cache(None)
    def rest(k, state, inserted):
        # state: the last role kept, '' before the first
        out = []
        if k == len(codes) and state in ("", "a"):
            out.append((0, ""))
        grammar = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if inserted < 3:
            for r in grammar.replace("s", ""):
                c, a = rest(k, r, inserted + 1)
                out.append((2 + c, "I" + a))
        if k < len(codes):
            role, gone, cut = codes[k]
            c, a = rest(k + 1, state, 0)
            out.append((3 + c, "D" + a))
            if not gone:
                for r in grammar:
                    if r == role:
                        c, a = rest(k + 1, r, 0)
                        out.append((cut + c, "K" + a))
                    if r != "s":
                        c, a = rest(k + 1, r, 0)
                        out.append((2 + cut + c, "R" + a))
        return min(out, default=(10 ** 9, ""))
    for k in range(len(codes), -1, -1):   # from the back, so that the stack stays flat
        for state in ("", "s", "u", "a"):
            rest(k, state, 0)
    return rest(0, "", 0)


def brute(rows):
    """Rows of ``(conv_id, turn, role, text)`` to the contract's results."""
    convs = {}
    for conv, turn, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        convs.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {conv: one(kept) for conv, kept in convs.items()}


def one(kept):
    kept = sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen, codes = [], set(), []
    for _, role, text in kept:
        fault = ("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else
                 "truncated" if BLANK.findall(text)[-1] not in ".!?" else "")
        seen.add((role, text))
        faults.append(fault)
        codes.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(tuple(codes))
    lines, state, k = [], "", 0
    for e in audit:
        role = {"u": "assistant"}.get(state, "user")
        if e == "I":
            lines.append((role, ""))
        else:
            if e != "D":
                lines.append((role if e == "R" else kept[k][1], kept[k][2]))
            k += 1
        state = lines[-1][0][0] if lines else ""
    assert LINE.fullmatch("".join(r[0] for r, _ in lines))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                        r.repaired_sha256) for r in df.collect()}


def damaged(df):
    from pyspark.sql import functions as F
    return C.repair(C.damage(df), F.col("gone"))


def test_query_equals_brute_force(spark):
    from sentimart.llm.queries import QUERIES
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    df = QUERIES["op13_conversations"](spark, SF)
    assert df.count() == len({r[0] for r in rows})
    assert got(df) == brute(rows)


def odd_rows():
    rnd = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "", None, "u"]
    texts = ["Yes.", "No", "Why?", " ", "", None, "Fine!\n\t", "A. b", "ß 🙂 漢."]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts))
            for c in range(300) for _ in range(rnd.randrange(9))]
    rows += [(None, t, "user", "Hello.") for t in range(4)] + [(None, None, None, None)]
    rows += [(900, 2 ** 62, "user", "A."), (900, None, "user", "x" * 200_000)]
    return rows + rows[:50]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame(
        [(*r, "k", 1, "x") for r in rows], SCHEMA + ", gone string, at int, audit string")
    assert got(damaged(df)) == brute(rows)


def test_empty_table_and_conversation_without_rows(spark):
    assert got(damaged(spark.createDataFrame([], SCHEMA))) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], SCHEMA)
    assert got(damaged(df)) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("block", [3, 512])
def test_long_conversation_over_many_tasks(spark, block, monkeypatch):
    """Half of all rows in one conversation, cut in blocks and partitions."""
    rnd = random.Random(block)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]),
             rnd.choice(["Same.", "Other", f"Text {t}.", f"Cut {t}", " "])) for t in range(1500)]
    rows += [(c, t, "user" if t % 2 else "assistant", f"T {c} {t}.") for c in range(300) for t in range(5)]
    monkeypatch.setattr(C, "BLOCK", block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    exp = {c: one([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got(C.repair(df)) == exp


def test_search_equals_the_plain_recurrence():
    rnd = random.Random(1)
    for _ in range(400):
        codes = [(rnd.choice("suao"), rnd.random() < .2, int(rnd.random() < .3))
                 for _ in range(rnd.randrange(12))]
        text = "".join("x" if gone else r.upper() if cut else r for r, gone, cut in codes)
        assert C.solve(text, C.START, C.DONE) == cheapest(tuple(codes))
