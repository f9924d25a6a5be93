"""Spelling variant grouping over the words of a corpus (operator 11).

1. Words and their counts: letter runs of every text, counted per task and
   summed by word.
2. Trie-node numbers. The words are dealt into sorted ranges; in each range
   one pass numbers the trie node of every prefix (a node is new below the
   longest common prefix with the word before). A prefix shared by words of
   two ranges is a prefix of the boundary between them, and these few nodes
   are numbered beforehand, so numbers agree everywhere and equal numbers mean
   equal prefixes. The same over the reversed words numbers the suffixes.
3. Pair dictionary. A word gives an entry (prefix node, suffix node) for every
   skipped position and for every place where a character could be inserted.
   Words that skip a position to the same pair differ by one replaced
   character; a word whose place has the pair that another skips to differs
   by that inserted character. A pair stands for one string with at most one
   hole, so it holds one word and one word per letter of the alphabet at most,
   however large the corpus: no group is ever large. Of a run of equal letters
   only the first is skipped for insertions, so every two neighbours meet
   exactly once and nothing is verified or made distinct afterwards.
4. A word's form is its most frequent neighbour if that is ``RATIO`` times as
   frequent; roots follow forms by pointer doubling (counts grow by ``RATIO``
   at each step, so a handful of rounds finish).

Words travel as integers from step 2 on (numbered in code-point order).

Columns: ``doc_id`` and ``text``; others are ignored. Defined cases: null and
empty texts have no words; a null id is written as nothing in the id's place;
repeated rows count as often as they occur; ties among forms go to the
smallest word in code-point order; very long runs are words like any other
(work and rows grow with their length, not its square); an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimart.llm.common import save, shuffle_partitions

# Fixed values of the contract.
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
DAMAGED = 199   # a run whose hash this divides loses a code point

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_HELD = 300_000      # distinct words a task holds before it passes their counts on
_ROWS = 65_536       # dictionary entries in one result batch
_BOUNDARY = 64       # code points of a range's boundary
_SAMPLED = 64        # words drawn per range to place the boundaries


def _counted(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"])

    # a damaged run loses one code point, so shorter runs give no word
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}").findall
    counts: Counter[str] = Counter()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not text:
                continue
            head = crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(runs(text)).items():
                run = run.lower() if run.isascii() else run.translate(_UPPER)
                h = crc32(run.encode(), head)
                if not h % DAMAGED:
                    k = h % len(run)
                    run = run[:k] + run[k + 1:]
                    if len(run) < least:
                        continue
                counts[run] += n
            if len(counts) > _HELD:
                yield out()
                counts.clear()
    yield out()


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: words of all texts with at least ``min_chars`` code points
    and ``min_count`` occurrences."""
    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
                .mapInArrow(lambda b: _counted(b, min_chars), "word string, n long")
                .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def boundaries(words: DataFrame, ranges: int) -> list[str]:
    """Boundaries of about ``ranges`` even ranges: some ``_SAMPLED`` words per
    range, at most ``_BOUNDARY`` characters each, so their size follows the
    number of ranges, not of words. Any boundaries give the same neighbours."""
    n = words.count()
    share = min(1.0, _SAMPLED * ranges / max(n, 1))
    drawn = (words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
                  .select(F.substring("word", 1, _BOUNDARY).alias("w")).limit(4 * _SAMPLED * ranges))
    drawn = sorted(r.w for r in drawn.collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)} if drawn else ())


def _lcp(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


class _Boundary:
    """Numbers (below zero) of the nodes of all prefixes of the boundaries."""

    def __init__(self, bounds: list[str]):
        self.paths, count, before, path = [], 0, "", [-1]
        for b in bounds:
            path = path[:_lcp(before, b) + 1]
            while len(path) <= len(b):
                count += 1
                path.append(-1 - count)
            self.paths.append(path)
            before = b
        self.bounds = bounds

    def known(self, word: str, k: int) -> list[int]:
        """Nodes of the word's prefixes that are prefixes of its range's
        boundaries (the k-th range lies between boundaries k - 1 and k)."""
        out = [-1]   # the root
        for at in (k - 1, k):
            if 0 <= at < len(self.bounds) and (d := _lcp(self.bounds[at], word)) + 1 > len(out):
                out = self.paths[at][:d + 1]
        return out


def trie_nodes(rows: DataFrame, key: str, keep: list[str], kinds: str, ranges: int, emit) -> DataFrame:
    """Numbers the trie nodes of the prefixes of the column ``key``, distinct
    per row. ``emit(kept values, word, order, nodes)`` makes the result rows of
    a word; ``order`` numbers the words in order, ``nodes[i]`` the prefix of i
    characters."""
    bounds = boundaries(rows.select(F.col(key).alias("word")), ranges)
    known = _Boundary(bounds)

    def deal(batches):
        for b in batches:
            of = [bisect_right(bounds, w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *b.columns],
                                             names=["range", *b.schema.names])

    def number(batches):
        now, before, nodes, count, order = None, "", [], 0, 0
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            out = []
            for k, word, *kept in zip(*cols):
                if k != now:
                    now, before, nodes, count, order = k, "", [], k << 40, k << 40
                # equal characters with the word before: its nodes, as far as they go
                nodes = nodes[:_lcp(before, word) + 1]
                shared = known.known(word, k)
                nodes[:len(shared)] = shared
                more = len(word) + 1 - len(nodes)
                nodes.extend(range(count + 1, count + 1 + more))
                count += more
                order += 1
                before = word
                out.append((kept, word, order, nodes))
            yield from emit(out)

    schema = rows.select(key, *keep).schema
    dealt = (rows.select(key, *keep)
                 .mapInArrow(deal, "range long, " + ", ".join(
                     f"`{f.name}` {f.dataType.simpleString()}" for f in schema)))
    return (dealt.repartition("range").sortWithinPartitions("range", key)
                 .mapInArrow(number, kinds))


def _forward(words: list) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array([o for _, _, o, _ in words], pa.int64()),
         pa.array([w for _, w, _, _ in words], pa.string()),
         pa.array([w[::-1] for _, w, _, _ in words], pa.string()),
         pa.array([kept[0] for kept, _, _, _ in words], pa.int64()),
         pa.array([nodes for _, _, _, nodes in words], pa.list_(pa.int64()))],
        names=["id", "word", "reversed", "n", "prefixes"])


_SKIP, _FIRST, _PLACE = 0, 1, 2   # a skipped position; the first of a run of equal letters; a place
_ENTRIES = "p long, s long, id long, n long, kind int"


def _entries(words: list) -> Iterator[pa.RecordBatch]:
    """Dictionary entries of words; given reversed, with their prefix nodes."""
    def out():
        cols = [np.concatenate(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()])],
            names=["p", "s", "id", "n", "kind"])

    held, size = [], 0
    for (word_id, n, prefixes), back, _, nodes in words:
        p, s = np.array(prefixes), np.array(nodes)[::-1]   # s[i]: the suffix from i on
        m = len(back)
        chars = np.frombuffer(back[::-1].encode("utf-32-le"), np.uint32)
        skip = np.where(np.r_[True, chars[1:] != chars[:-1]], _FIRST, _SKIP)
        held.append((np.r_[p[:-1], p], np.r_[s[1:], s], np.full(2 * m + 1, word_id),
                     np.full(2 * m + 1, n), np.r_[skip, np.full(m + 1, _PLACE)]))
        size += 2 * m + 1
        if size > _ROWS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def neighbours(entries: DataFrame) -> DataFrame:
    """``(id, n_near, best_n, best)`` of the words that have neighbours."""
    member = F.struct((-F.col("n")).alias("less"), "id", "kind")
    # at most one word per letter, and one of the pair itself
    groups = (entries.groupBy("p", "s").agg(F.sort_array(F.collect_list(member)).alias("m"))
                     .where(F.size("m") > 1))
    inserted = F.filter("m", lambda x: x.kind == _FIRST)
    skipped = F.filter("m", lambda x: x.kind != _PLACE)
    place = F.filter("m", lambda x: x.kind == _PLACE)
    groups = groups.select(F.explode("m").alias("x"), skipped.alias("skipped"),
                           inserted.alias("inserted"), place.alias("place"))
    # by replacement: the others that skip to the pair; by insertion: the word
    # whose place it is, or all that skip to it
    near = (F.when(F.col("x.kind") == _PLACE, F.col("inserted"))
             .otherwise(F.concat(F.filter("skipped", lambda y: y.id != F.col("x.id")),
                                 F.when(F.col("x.kind") == _FIRST, F.col("place"))
                                  .otherwise(F.filter("place", lambda y: F.lit(False))))))
    best = F.array_min("near")
    return (groups.select(F.col("x.id").alias("id"), near.alias("near"))
                  .where(F.size("near") > 0)
                  .select("id", F.size("near").alias("k"),
                          F.struct(best["less"].alias("less"), best["id"].alias("id")).alias("b"))
                  .groupBy("id").agg(F.sum("k").alias("n_near"), F.min("b").alias("b"))
                  .select("id", "n_near", (-F.col("b.less")).alias("best_n"),
                          F.col("b.id").alias("best")))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``(id, root)`` for ``forms(id, form)``: the end of each chain, by
    pointer doubling. A chain's counts grow ``ratio``-fold, up to ``most``."""
    steps = max(1, ceil(log(max(most, 2), ratio)))
    now = forms.select("id", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        now = save(now, "roots")
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        now = now.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return now


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
             ratio: int = RATIO, ranges: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n``, one row per word."""
    spark = docs.sparkSession
    ranges = ranges or shuffle_partitions(spark)
    counts = save(word_counts(docs, min_chars, min_count), "words")
    forward = save(trie_nodes(counts, "word", ["n"],
                              "id long, word string, reversed string, n long, prefixes array<long>",
                              ranges, _forward), "prefixes")
    entries = trie_nodes(forward, "reversed", ["id", "n", "prefixes"], _ENTRIES, ranges, _entries)
    near = save(neighbours(entries), "near")
    words = forward.select("id", "word", "n")
    known = save(words.join(near, "id", "left")
                      .withColumn("form", F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))),
                 "known")
    most = known.agg(F.max("n")).first()[0] or 0
    root = roots(known.where(F.col("form").isNotNull()).select("id", "form"), most, ratio)
    form = words.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
    end = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return (known.join(form, "form", "left").join(root, "id", "left").join(end, "root", "left")
                 .select("word", F.col("form_word").alias("form"),
                         F.coalesce("root_word", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")))
