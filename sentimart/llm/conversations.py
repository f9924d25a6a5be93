"""Conversation structure repair (operator 13).

A conversation is repaired by the cheapest edits after which its role
initials read ``(s?(ua)+)?``: Keep a row, Rerole it to user or assistant,
Delete it, Insert an empty user or assistant row. Blank rows and rows whose
role and text were seen earlier must go. Ties go to the ASCII-least string of
edit initials (``audit``), which alone determines the repaired rows, as every
edit leads to one next state (nothing yet, system, user, assistant).

1. One range exchange by (conversation, turn, role, text) puts the rows in
   order, and a conversation of any size into as many partitions as it needs.
2. Each task streams its rows in blocks of one conversation, ``BLOCK`` rows or
   ``BLOCK_CHARS`` characters at most. A block is solved by depth-first
   branch-and-bound over (row, state): an explicit stack, the cheapest cost of
   the rows left from every state as lower bound, the incumbent (cost, audit),
   and per node the best prefix so far, which eliminates worse ones; the search
   ends when the stack holds nothing that could beat the incumbent.
3. A block that is a whole conversation gives its result at once. The blocks
   of longer or cut conversations are solved for every entry and exit state, in
   parallel, and folded in order: the fold holds four (cost, audit, hash)
   candidates, reads a block at a time, and sets aside the part of the audit
   that all four share. SHA-256 can't be split, so this pass over the bytes of
   one conversation is one task; it gathers nothing.

Which rows are seen earlier is found before, by the first place of every
(conversation, role, text), combined before it moves.

Columns: ``conv_id`` and ``turn`` long, ``role`` and ``text`` string; others
are ignored. Defined cases: a null is read as one space (a null turn sorts
first and counts for no gap, a null id is a conversation of its own); rows of
one turn are taken by role, then text, in code-point order; repeated rows are
duplicates but for one; a conversation without rows has zeros, an empty audit
and the empty text's hash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.llm.common import WORD, save

BLOCK = 512               # rows of a conversation solved at once
BLOCK_CHARS = 4_000_000   # and their characters
_SOLVED = 100_000         # distinct blocks a task remembers
_ROWS = 2_048             # conversations in one result batch

# Fixed values of the contract: costs of the edits, and the rows that grammar
# takes next in each state (before the first row, after s, after u, after a).
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLE = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
TURN = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # of an inserted or retyped row
DONE = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

# A row as one character: its initial (o: any other), upper case if truncated;
# x: must be deleted.


def _edits(code: str | None, state: int) -> Iterator[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of the edits at a row (None: behind the
    last), in ASCII order."""
    if code is not None:
        yield "D", DELETE, state
    yield "I", INSERT, STATE[TURN[state]]
    if code is not None and code != "x":
        more = TRUNCATED if code.isupper() else 0
        if code.lower() in NEXT[state]:
            yield "K", more, STATE[code.lower()]
        yield "R", RETYPE + more, STATE[TURN[state]]


def _bounds(codes: str, goals: tuple[int, ...]) -> list[list[int]]:
    """For every row and state, the least cost of what is left up to a goal."""
    def settle(costs: list[float]) -> list[float]:
        for _ in range(3):  # three inserts lead from any state to any that can be met
            costs = [min(costs[s], INSERT + costs[STATE[TURN[s]]]) for s in range(4)]
        return costs

    out = [settle([0 if s in goals else float("inf") for s in range(4)])]
    for code in reversed(codes):
        after = out[-1]
        out.append(settle([min(c + after[t] for e, c, t in _edits(code, s) if e != "I")
                           for s in range(4)]))
    return out[::-1]


@lru_cache(_SOLVED)
def solve(codes: str, entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Cheapest ``(cost, audit)`` from the entry state to one of the goals,
    ASCII-least among equals; None if there is none."""
    n, bounds = len(codes), _bounds(codes, goals)
    best: tuple[float, str] = (float("inf"), "")
    least: dict[tuple[int, int], tuple[int, str]] = {}   # dominance: best prefix of a node
    stack = [(0, entry, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        bound = cost + bounds[row][state]
        if bound > best[0] or bound == best[0] and audit >= best[1]:
            continue
        if (row, state) in least and least[row, state] <= (cost, audit):
            continue
        least[row, state] = cost, audit
        if row == n and state in goals:
            best = min(best, (cost, audit))
        code = codes[row] if row < n else None
        found = [(row + (e != "I"), t, cost + c, audit + e) for e, c, t in _edits(code, state)]
        stack += found[::-1]
    return best if best[0] < float("inf") else None


def repaired(audit: str, rows: Iterable[tuple[str, str]], state: int) -> Iterator[str]:
    """Lines ``role:text`` after the edits, from a state on."""
    rows = iter(rows)
    for e in audit:
        if e == "I":
            role, text = ROLE[TURN[state]], ""
        else:
            role, text = next(rows)
            if e == "D":
                continue
            if e == "R":
                role = ROLE[TURN[state]]
        yield f"{role}:{text}"
        state = STATE[role[0]]


class _Faults:
    """What is counted along a conversation; two neighbours can be joined."""

    FIELDS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal")

    def __init__(self):
        self.low = self.high = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, fault) -> None:
        other = _Faults()
        other.first = other.last = role[:1]
        if turn is not None:
            other.low, other.high, other.turns = turn, turn, 1
        if fault:
            setattr(other, fault, 1)
        self.join(other)

    def join(self, other: _Faults) -> None:
        if other.first is None:
            return
        if self.first is None:
            self.first = other.first
        else:
            self.illegal += self.last + other.first not in LEGAL
        self.last = other.last
        if other.low is not None:
            self.turns -= self.high == other.low
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        for f in ("turns", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, f, getattr(self, f) + getattr(other, f))

    def values(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal}


_RESULT = pa.schema([("conv_id", pa.int64()), *[(f, pa.int64()) for f in
                     ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_WAY = pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()),
                  ("audit", pa.string())])
_PART = pa.schema([*_RESULT, ("at", pa.int64()), ("ways", pa.list_(_WAY)),
                   ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
                   *[(f, pa.int64()) for f in _Faults.FIELDS[:3]],
                   ("first", pa.string()), ("last", pa.string())])
_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
        "cost long, audit string, repaired_sha256 string")
_PART_DDL = (_DDL + ", at long, ways array<struct<entry: int, goal: int, cost: bigint, "
             "audit: string>>, roles array<string>, texts array<string>, low long, high long, "
             "turns long, first string, last string")


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += sum(map(len, r.get("texts") or ()))
        if len(out) == _ROWS or size > BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


class _Block:
    def __init__(self, conv_id):
        self.conv_id, self.faults = conv_id, _Faults()
        self.codes, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn, role, text, fault) -> None:
        self.faults.add(turn, role, fault)
        code = role[:1] if role[:1] in STATE else "o"
        self.codes.append("x" if fault in ("blank", "duplicate") else
                          code.upper() if fault else code)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def whole(self) -> dict:
        """The result of a block that is a whole conversation."""
        cost, audit = solve("".join(self.codes), START, DONE)
        lines = "\n".join(repaired(audit, zip(self.roles, self.texts), START))
        return {"conv_id": self.conv_id, **self.faults.values(), "cost": cost, "audit": audit,
                "repaired_sha256": hashlib.sha256(lines.encode()).hexdigest()}

    def part(self, at: int) -> dict:
        """All ways through a block that others precede or follow."""
        codes = "".join(self.codes)
        ways = [{"entry": e, "goal": g, "cost": w[0], "audit": w[1]}
                for e in range(4) for g in range(4) if (w := solve(codes, e, (g,)))]
        f = self.faults
        return {"conv_id": self.conv_id, **f.values(), "at": at, "ways": ways,
                "roles": self.roles, "texts": self.texts, "low": f.low, "high": f.high,
                "turns": f.turns, "first": f.first, "last": f.last}


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Results of whole conversations and parts of cut ones, from sorted rows.
    The first and the last conversation of a partition may go on outside it."""
    at = TaskContext.get().partitionId() << 32
    block, alone, before = None, False, None
    for b in batches:
        for conv_id, gone, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns)):
            if block is None or block.conv_id != conv_id:
                if block is not None:
                    yield block.whole() if alone else block.part(at)
                    at += 1
                alone, before = block is not None, None
                block = _Block(conv_id)
            elif len(block.codes) == BLOCK or block.chars > BLOCK_CHARS:
                yield block.part(at)
                at += 1
                block, alone = _Block(conv_id), False
            if gone:
                continue
            row = turn, role, text
            if row == before and fault != "blank":
                fault = "duplicate"
            before = row
            block.add(turn, role, text, fault)
    if block is not None:
        yield block.part(at)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One result for each conversation of sorted parts."""
    conv, some = None, False

    def close() -> dict:
        cost, tail, _, sha = min((now[s] for s in DONE if s in now), key=lambda x: x[:2])
        return {"conv_id": conv, **faults.values(), "cost": cost, "audit": "".join(head) + tail,
                "repaired_sha256": sha.hexdigest()}

    for b in batches:
        for p in b.to_pylist():
            if not some or p["conv_id"] != conv:
                if some:
                    yield close()
                conv, some, head, faults = p["conv_id"], True, [], _Faults()
                now = {START: (0, "", False, hashlib.sha256())}  # cost, audit, any line, hash
            f = _Faults()
            for k in ("low", "high", "turns", "first", "last", "blank", "duplicate", "truncated",
                      "illegal"):
                setattr(f, k, p[k])
            faults.join(f)
            best = {}
            for w in p["ways"]:
                if w["entry"] in now:
                    cost, tail = now[w["entry"]][:2]
                    way = cost + w["cost"], tail + w["audit"], w["entry"], w["audit"]
                    if w["goal"] not in best or way[:2] < best[w["goal"]][:2]:
                        best[w["goal"]] = way
            after = {}
            for goal, (cost, tail, entry, audit) in best.items():
                any_line, sha = now[entry][2], now[entry][3].copy()
                for line in repaired(audit, zip(p["roles"], p["texts"]), entry):
                    sha.update((("\n" if any_line else "") + line).encode())
                    any_line = True
                after[goal] = cost, tail, any_line, sha
            shared = len(os.path.commonprefix([x[1] for x in after.values()]))
            head.append(next(iter(after.values()))[1][:shared])
            now = {s: (c, tail[shared:], y, sha) for s, (c, tail, y, sha) in after.items()}
    if some:
        yield close()


def repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row for each conversation: ``conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256``. Rows with ``gone`` are
    left out, but their conversation has a result."""
    gone = F.lit(False) if gone is None else F.coalesce(gone.cast("boolean"), F.lit(False))
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select(F.col("conv_id").cast("long"), gone.alias("gone"),
                       F.col("turn").cast("long"), *spaced)
    # 128 bits of the whole (conversation, role, text), lengths keeping them apart
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")),
                            F.char_length("role"), "role", "text"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumn("key", key)
    seen = (rows.where(~F.col("gone")).groupBy("key")
                .agg(F.min(place).alias("seen"), F.count(F.lit(1)).alias("n"))
                .where(F.col("n") > 1).select("key", "seen"))
    fault = (F.when(~F.col("text").rlike(WORD), "blank")
              .when(F.col("seen") < place, "duplicate")
              .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated"))
    order = ["conv_id", "turn", "role", "text"]
    ordered = (rows.join(seen, "key", "left")
                   .select("conv_id", "gone", "turn", "role", "text", fault.alias("fault"))
                   .repartitionByRange(*order).sortWithinPartitions(*order))
    solved = save(ordered.mapInArrow(lambda b: _batches(_stream(b), _PART), _PART_DDL), "solved")
    whole = solved.where(F.col("at").isNull()).select(*_RESULT.names)
    parts = (solved.where(F.col("at").isNotNull()).repartition("conv_id")
                   .sortWithinPartitions("conv_id", "at"))
    return whole.unionByName(
        parts.mapInArrow(lambda b: _batches(_fold(b), _RESULT), _DDL))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage, by the row's place: drops, empties, cuts the
    sentence ends of, repeats or retypes one row in twenty each. Dropped rows
    stay, with ``gone`` set."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = (F.crc32(F.concat_ws(":", *spaced)) % 20).cast("int")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    damaged = rows.select(
        "conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
         .otherwise(text).alias("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return damaged.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"),
                          F.explode(times).alias("copy")).drop("copy")
