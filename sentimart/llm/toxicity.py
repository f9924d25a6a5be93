"""Toxicity scores behind a noisy-channel deobfuscation (operator 12).

1. Character language model: trigrams of the letters of all texts, counted by
   numpy per task and summed by Spark. Its table has ``LETTERS`` cubed entries
   whatever the corpus, so it may be collected and sent to the executors.
2. Restoring. A token that is not plain letters (leetspeak, letters apart,
   letters repeated three times or more) becomes a lattice: every character
   may stand for the letters it is used for, for itself (it ends a word), or,
   as a separator or repetition, for nothing, each at a channel cost. Viterbi
   over pairs of letters finds the likeliest reading under channel and
   language model. Every token also reads as it is, so nothing that is plain
   to see is lost. A task restores each distinct token once.
3. Evidence. Words, their beginnings and ends of the restored labelled texts
   are counted by label, and those that are found in toxic texts more often
   than chance allows keep their log-odds (a table of at most ``FEATURES``).
4. The score is a logistic regression on a text's evidence: the strongest, the
   sum, the number, and the text's length. It is fitted by texts scored with
   the log-odds of the other half of the training rows.

Labels are taken from at most ``SAMPLED`` labelled training rows, the smallest
by a hash of their id; the language model and the scores cover all rows.

Columns: ``doc_id`` and ``text`` of the documents, ``doc_id`` and ``toxic`` of
the labels; others are ignored. Defined cases: null and empty texts have no
evidence and get the score of that; a null id has no label and, written as
nothing, is held out; of several labels of one id the largest counts; repeated
rows give repeated rows with equal scores; without labels of both kinds the
score is the rate of the toxic ones (0 without any); an empty table of
documents gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.llm.common import save

FOLDS = 5            # contract: rows whose crc32 of the id has remainder 0 are held out
SAMPLED = 200_000    # labelled rows a model is fitted on, at most
FEATURES = 20_000    # evidence kept, at most
CALIBRATED = 50_000  # of the sampled rows, those the regression is fitted on, at most
MIN_TOXIC, MIN_Z = 3, 4.0    # texts and standard errors that make an evidence

# The letters that characters stand for in leetspeak, and the
# costs of the channel in nats.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
        "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
        "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " .-_*'~/"
AS_LETTER, AS_ITSELF, OUTSIDE, REPEATED = 1.0, 6.0, 2.0, 0.5   # outside: a symbol beside the letters
BREAK, JOIN = 4.0, 3.0   # a word's end among letters apart; a separator dropped elsewhere

_FIRST, LETTERS = 0xDF, 60    # 0 ends a word, a-z are 1 to 26, ß to ÿ 27 to 59
_CLASS = np.zeros(257, np.int64)
_CLASS[ord("a"):ord("z") + 1] = np.arange(1, 27)
_CLASS[_FIRST:0x100] = np.arange(27, LETTERS)
_CLASS[0xF7] = 0              # the division sign
_CHARS = 1_000_000            # characters counted at a time
_TOKENS = 200_000             # distinct tokens a task remembers at a time
_HELD = 300_000               # distinct evidence a task holds before it passes the counts on
_BACK = 20.0                  # weight of the shorter context in the language model

_PLAIN = re.compile(r"(?:[^\w$@]|_)*([^\W\d_]+)(?:[^\w$@]|_)*")
_WORDS = re.compile(r"[^\W\d_]+")
_LETTER = r"(?:[^\W_]|[@$!|])"
_APART = re.compile(rf"(?<!\S){_LETTER}(?:[ ._*-]{_LETTER}){{2,}}(?!\S)")
_RUN = re.compile(r"(.)\1\1+", re.S)


# ---- language model ---------------------------------------------------------

def letter_counts(docs: DataFrame) -> DataFrame:
    """``(code, n)``: trigrams of letter classes over all texts."""
    def pieces(texts):
        # two blanks around every text, so that its trigrams don't hang on its neighbours
        held, size = [], 0
        for text in texts:
            for at in range(0, len(text), _CHARS):
                held.append(text[max(at - 2, 0):at + _CHARS])
                size += len(held[-1])
                if size >= _CHARS:
                    yield "  ".join(["", *held, ""])
                    held, size = [], 0
        yield "  ".join(["", *held, ""])

    def run(batches):
        counts = np.zeros(LETTERS ** 3, np.int64)
        for b in batches:
            for part in pieces(filter(None, b.column(0).to_pylist())):
                c = _CLASS[np.minimum(np.frombuffer(part.lower().encode("utf-32-le"), "<u4"), 256)]
                counts += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:],
                                      minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["code", "n"])
    return (docs.select(F.col("text").cast("string")).mapInArrow(run, "code long, n long")
                .groupBy("code").agg(F.sum("n").alias("n")))


def letter_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) ``[a, b, c]`` of c after a and b, each
    context smoothed by the shorter one."""
    n = np.zeros(LETTERS ** 3)
    for r in counts.collect():   # at most LETTERS cubed rows
        n[r.code] = r.n
    n = n.reshape((LETTERS,) * 3)
    p = np.full(LETTERS, 1 / LETTERS)
    for axes in ((0, 1), (0,), ()):
        c = n.sum(axis=axes)
        p = (c + _BACK * p) / (c.sum(axis=-1, keepdims=True) + _BACK)
    return -np.log(p)


# ---- restoring --------------------------------------------------------------

def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What every character may stand for, with its cost: a letter, a word's
    end (a blank) or nothing."""
    out = []
    token = _RUN.sub(lambda m: m[1] * 2 + "\0", token.replace("\0", " "))   # marks behind runs
    letters = [i for i, c in enumerate(token) if c.isalpha()]
    first, last = (letters[0], letters[-1]) if letters else (0, 0)
    for i, c in enumerate(token):
        if c == "\0":
            out[-1] = [*out[-1], ("", REPEATED)]
        elif c.isalpha():
            out.append([(c, 0.0)])
        elif c in LEET:
            outside = not c.isdigit() and not first < i < last
            out.append([*((x, AS_LETTER) for x in LEET[c]), (" ", OUTSIDE if outside else AS_ITSELF)])
        elif c in SEPARATORS:
            # between two single characters?
            apart = all(not 0 <= k < len(token) or token[k] in SEPARATORS for k in (i - 2, i + 2))
            out.append([("", 0.0), (" ", BREAK)] if apart else [("", JOIN), (" ", 0.0)])
        else:
            out.append([(" ", 0.0)])
    return out


def _index(c: str) -> int:
    return int(_CLASS[min(ord(c), 256)])


def viterbi(choices: list[list[tuple[str, float]]], model: list) -> str:
    """The likeliest reading of a lattice."""
    best = {(0, 0): (0.0, None)}   # last two letters: cost, what was read
    for options in [*choices, [(" ", 0.0)]]:
        after: dict = {}
        for (a, b), (cost, read) in best.items():
            row = model[a][b]
            for c, channel in options:
                if not c or c == " " and not b:   # nothing, or one more blank
                    state, total, way = (a, b), cost + channel, read
                else:
                    k = _index(c)
                    state, total, way = (b, k), cost + channel + row[k], (read, c)
                if state not in after or total < after[state][0]:
                    after[state] = total, way
        best = after
    read, out = min(best.values(), key=lambda x: x[0])[1], []
    while read:
        read, c = read
        out.append(c)
    return "".join(reversed(out)).strip()


def restore(token: str, model: list) -> tuple[str, ...]:
    """Words that a lower-cased token reads as."""
    plain = _PLAIN.fullmatch(token)
    if plain and not _RUN.search(plain[1]):
        return (plain[1],)
    letters = {c for c in token if c.isalpha()}
    if not letters or len(letters) == 1 and not any(c in LEET for c in token):
        return ()
    return tuple(dict.fromkeys(_WORDS.findall(f"{viterbi(lattice(token), model)} {token}")))


class _Memo(dict):
    """Remembers a bounded number of distinct tokens."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, token):
        if len(self) >= _TOKENS:
            self.clear()
        value = self[token] = self.make(token)
        return value


def tokens(text: str | None) -> set[str]:
    """Distinct tokens of a text, and its runs of letters set apart."""
    text = (text or "").lower()
    out = set(text.split())
    if any(len(t) == 1 for t in out):
        out.update(_APART.findall(text))
    return out


def evidence(words: tuple[str, ...]) -> list[str]:
    """What may tell of a word: itself, its beginnings and its end."""
    out = []
    for w in words:
        if len(w) > 2:
            out.append(w)
        if len(w) > 5:
            out += [w[:4] + "-", w[:5] + "-", "-" + w[-5:]]
    return out


# ---- fitting ----------------------------------------------------------------

def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def sample(labels: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """``(doc_id, toxic, h)`` of at most ``sampled`` training rows, the
    smallest by hash."""
    return (labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
                  .where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0))
                  .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                  .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sampled))


def training_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(text, toxic, half)`` of the sampled rows. Their labels are broadcast:
    they are ``SAMPLED`` pairs of numbers at most."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                .join(F.broadcast(known), "doc_id")
                .select("text", "toxic", F.pmod("h", F.lit(2)).cast("int").alias("half")))


def evidence_counts(rows: DataFrame, model: Broadcast) -> DataFrame:
    """``(word, clean_0, toxic_0, clean_1, toxic_1)``: texts of either half and
    label that hold an evidence; the empty word counts all texts."""
    names = ["clean_0", "toxic_0", "clean_1", "toxic_1"]

    def run(batches):
        def out():
            words = sorted(set().union(*held))
            cols = [pa.array([c[w] for w in words], pa.int64()) for c in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *cols],
                                              names=["word", *names])
        table = model.value.tolist()
        memo = _Memo(lambda t: evidence(restore(t, table)))
        held = [Counter() for _ in names]
        for b in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in b.columns)):
                one = held[2 * half + (toxic > 0)]
                one.update(set().union([""], *map(memo.__getitem__, tokens(text))))
                if sum(map(len, held)) > _HELD:
                    yield out()
                    held = [Counter() for _ in names]
        yield out()

    return (rows.select("text", "toxic", "half")
                .mapInArrow(run, "word string, " + ", ".join(f"{n} long" for n in names))
                .groupBy("word").agg(*[F.sum(n).alias(n) for n in names]))


def weights(counts: DataFrame, toxic: list[str], clean: list[str],
            features: int = FEATURES) -> dict[str, float]:
    """Log-odds of the evidence for toxic texts, the clearest ``features``."""
    both = counts.select("word", sum(F.col(c) for c in toxic).alias("t"),
                         sum(F.col(c) for c in clean).alias("c"))
    total = both.where(F.col("word") == "").first()
    if total is None or not total.t or not total.c:
        return {}
    rate = (F.col("t") + F.col("c")) / (total.t + total.c)
    z = ((F.col("t") / total.t - F.col("c") / total.c)
         / F.sqrt(rate * (1 - rate) * (1 / total.t + 1 / total.c)))
    odds = F.log((F.col("t") + 0.5) / (total.t + 1)) - F.log((F.col("c") + 0.5) / (total.c + 1))
    found = (both.where((F.col("word") != "") & (F.col("t") >= MIN_TOXIC) & (rate < 1))
                 .select("word", odds.alias("w"), z.alias("z")).where(F.col("z") >= MIN_Z)
                 .orderBy(F.desc("z"), "word").limit(features))
    return {r.word: r.w for r in found.collect()}


def measures(model: Broadcast, kept: Broadcast) -> Callable[[str | None, int], list[float]]:
    """A text's evidence under one of the weight tables ``kept``: strongest,
    sum (as logarithm), number (as logarithm), logarithm of the length."""
    table = model.value.tolist()
    memos = [_Memo(lambda t, w=w: max((w.get(e, 0.0) for e in evidence(restore(t, table))),
                                      default=0.0)) for w in kept.value]

    def of(text: str | None, which: int) -> list[float]:
        found = tokens(text)
        hits = [w for w in map(memos[which].__getitem__, found) if w > 0]
        return [max(hits, default=0.0), math.log1p(math.fsum(hits)), math.log1p(len(hits)),
                math.log1p(len(found))]
    return of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty,
                               x.T @ (p - y) + penalty @ beta)
        beta = beta - step
        if np.abs(step).max() < 1e-6:
            break
    return beta


_X = ["strongest", "total", "number", "length"]


def fit(docs: DataFrame, labels: DataFrame, model: Broadcast,
        sampled: int = SAMPLED) -> tuple[dict[str, float], np.ndarray]:
    """Weights of the evidence and coefficients of the regression."""
    sc = docs.sparkSession.sparkContext
    known = save(sample(labels, sampled), "labels")
    counts = save(evidence_counts(training_rows(docs, known), model), "evidence")
    halves = [weights(counts, [f"toxic_{k}"], [f"clean_{k}"]) for k in (1, 0)]   # of the other half
    kept = sc.broadcast(halves)

    def run(batches):
        of = measures(model, kept)
        for b in batches:
            text, toxic, half = (c.to_pylist() for c in b.columns)
            x = np.array([of(t, k) for t, k in zip(text, half)]).reshape(-1, len(_X))
            yield pa.RecordBatch.from_arrays([b.column(1), *map(pa.array, x.T.copy())],
                                             names=["toxic", *_X])

    few = training_rows(docs, known.orderBy("h", "doc_id").limit(CALIBRATED))
    seen = np.array([tuple(r) for r in
                     few.mapInArrow(run, "toxic int, " + ", ".join(f"{n} double" for n in _X))
                        .collect()]).reshape(-1, 1 + len(_X))   # five numbers a row
    seen = seen[np.lexsort(seen.T)]   # sums of one order, so that reruns agree to the last bit
    y = (seen[:, 0] > 0).astype(float)
    if not 0 < y.sum() < len(y):
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-9, 1 - 1e-9))
        return {}, np.array([0.0] * len(_X) + [math.log(rate / (1 - rate))])
    return weights(counts, ["toxic_0", "toxic_1"], ["clean_0", "clean_1"]), logistic(seen[:, 1:], y)


def score(docs: DataFrame, labels: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_evidence``, one row per row."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(letter_model(letter_counts(docs)))
    found, beta = fit(docs, labels, model, sampled)
    kept = sc.broadcast([found])

    def run(batches):
        of = measures(model, kept)
        for b in batches:
            x = np.array([of(t, 0) for t in b.column(1).to_pylist()]).reshape(-1, len(_X))
            p = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64))],
                names=["doc_id", "score", "n_evidence"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                .mapInArrow(run, "doc_id long, score double, n_evidence long")
                .select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_evidence"))
