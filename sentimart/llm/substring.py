"""Substring dedup by sliding sentence spans (operator 7).

A text is cut into sentences: after ``. ! ?`` with white space, after a line
break, and before a capital letter that follows white space (so a quotation
spliced into the middle of a sentence starts a sentence of its own). A
sentence of more than ``_GRAIN`` words is cut further, after the word with
the least hash of every ``_GRAIN`` words in a row; the parts count as
sentences. Every run of consecutive sentences is hashed, in its shortest
form: from each start and up to each end the shortest run of two or more
sentences with ``min_words`` words, and each single sentence of
``long_words`` words. Equal passages give equal runs wherever they stand.

A stretch of 51 equal words that begins and ends inside sentences holds such
a run too: the cuts depend on the words near them alone, so from the first
cut inside the stretch (at most 16 words from its start) to the last (at most
15 words from its end) both copies have the same parts, 20 words or more in
two parts or more. Up to that many words at either end stay. Line breaks end
sentences, so copies with other line breaks are other passages.

The run hashes of all documents meet in one join: per hash the first place
(smallest id, then text hash, then position) is kept, every other place
marks its sentences for removal, and marked sentences leave the text.

Plan: runs are made one Arrow batch at a time, twice, which costs less than
keeping them. The first time only 48 bits of each hash are counted, with
map-side combine; the second time the runs (96 hash bits, document key, first
and last sentence) meet the repeated ones, and what is left is saved. The
first places are an aggregate of that, saved, and joined back. All joins are
plain exchanges, so Spark may split a passage that a third of all documents
share. Texts move once, to meet the runs to remove.

Columns: ``doc_id`` and ``text``; others are kept as they are. Defined
cases: null and blank texts have no runs and stay as they are; repeated rows
(same id and text) are one document and get the same result; rows with a
null id come last in the order; a text whose sentences are all removed
becomes empty; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimart.llm.common import MAX_ID, ROW, save

MIN_SENTENCES = 2   # a run has this many sentences or more ...
MIN_WORDS = 20      # ... and this many words or more,
LONG_WORDS = 30     # or is one sentence of this many words or more

_ROWS = 256         # texts handled at a time
_GRAIN = 16         # words in a row that have a cut: 51 words less 16 and 15 are 20

_TOKEN = re.compile(r"\s*\S+\s*")
_END = regex.compile(r"(?<=[.!?])\s+|\n\s*|\s+(?=\p{Lu})")


# factors of the run hashes, and their inverses modulo 2^64
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(f, -1, 2 ** 64) for f in _FACTORS)


def _raw(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        out.append(text[at:m.end()])
        at = m.end()
    if at < len(text):
        out.append(text[at:])
    return out


def _cuts(long: list[list[str]]) -> list[list[int]]:
    """Places in the words of each sentence, ends included, where it is cut:
    after the first word of least hash of every ``_GRAIN`` words in a row."""
    n = np.array([len(w) for w in long], np.int64)
    h = np.fromiter(map(xxhash.xxh32_intdigest, chain.from_iterable(long)), np.uint64, n.sum())
    least = h << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size < _GRAIN:
        step = min(size, _GRAIN - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    owner = np.repeat(np.arange(len(n)), n)
    inside = owner[:len(least)] == owner[_GRAIN - 1:]
    ends = np.cumsum(n)
    at = np.union1d((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64) + 1, ends)
    local = (at - (ends - n)[owner[at - 1]]).tolist()
    stop = np.searchsorted(at, ends, "right").tolist()
    return [local[i:j] for i, j in zip([0, *stop], stop)]


def sentences(text: str) -> list[str]:
    """The sentences of a text, long ones in parts, each with the white space
    that follows it; joined they are the text."""
    raw = _raw(text)
    long = {k: w for k, w in ((k, x.split()) for k, x in enumerate(raw)) if len(w) > _GRAIN}
    if not long:
        return raw
    out, at = [], 0
    for k, ends in zip(long, _cuts(list(long.values()))):
        out += raw[at:k]
        tokens = _TOKEN.findall(raw[k])
        out += ["".join(tokens[i:j]) for i, j in zip([0, *ends], ends)]
        at = k + 1
    return out + raw[at:]


def _spans(counts: np.ndarray, start: np.ndarray, end: np.ndarray, min_sentences: int,
           min_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the runs, given the words of each sentence
    of all texts and the first and the end of the sentences of its text."""
    k = np.arange(len(counts))
    total = np.concatenate([[0], np.cumsum(counts)])
    last = np.maximum(np.searchsorted(total, total[:-1] + min_words) - 1, k + min_sentences - 1)
    first = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1,
                       k - min_sentences + 1)
    down, up, one = last < end, first >= start, counts >= long_words
    key = np.unique(np.concatenate([k[down] << 32 | last[down], first[up] << 32 | k[up],
                                    k[one] << 32 | k[one]]))
    return key >> 32, key & 0xFFFFFFFF


def spans(counts: list[int], min_sentences: int, min_words: int, long_words: int) -> list[tuple]:
    """``(first, last)`` of the shortest runs from every start and up to every
    end, and of the long sentences, given the words of each sentence."""
    n = len(counts)
    i, j = _spans(np.array(counts, np.int64), np.zeros(n, np.int64), np.full(n, n),
                  min_sentences, min_words, long_words)
    return list(zip(i.tolist(), j.tolist()))


def _runs(texts: list[str | None], min_sentences: int, min_words: int,
          long_words: int) -> tuple[np.ndarray, ...]:
    """``row, h1, h2, first, last`` of every run of the texts; a run's hash is
    the sum of its sentences' hashes, each times a power of a factor."""
    words, size = [], []
    for t in texts:
        w = [x.split() for x in _raw(t)] if t else []
        words += w
        size.append(len(w))
    long = [w for w in words if len(w) > _GRAIN]
    cuts = iter(_cuts(long) if long else ())
    parts, counts, grown = [], [], []
    for w in words:
        if len(w) > _GRAIN:
            ends = next(cuts)
            parts += [" ".join(w[i:j]) for i, j in zip([0, *ends], ends)]
            counts += [j - i for i, j in zip([0, *ends], ends)]
            grown.append(len(ends))
        else:
            parts.append(" ".join(w))
            counts.append(len(w))
            grown.append(1)
    of_sentence = np.concatenate([[0], np.cumsum(np.array(grown, np.int64))])
    edge = of_sentence[np.concatenate([[0], np.cumsum(size)]).astype(np.int64)]
    row = np.repeat(np.arange(len(texts)), np.diff(edge))
    start = edge[row]
    i, j = _spans(np.array(counts, np.int64), start, edge[row + 1], min_sentences, min_words,
                  long_words)
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)
    h = []
    for c, (f, g) in enumerate(zip(_FACTORS, _INVERSES)):
        power, back = (np.cumprod(np.full(len(parts), x, np.uint64)) for x in (f, g))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest[:, c] * power)])
        h.append((total[j + 1] - total[i]) * back[i])
    return (row[i], h[0].view(np.int64), (h[1] >> np.uint64(32)).astype(np.uint32).view(np.int32),
            (i - start[i]).astype(np.int32), (j - start[i]).astype(np.int32))


def runs(text: str, min_sentences: int, min_words: int, long_words: int) -> list[tuple]:
    """``(hash, first, last)`` of every run, positions 0-based inclusive."""
    _, h1, h2, i, j = (x.tolist() for x in _runs([text], min_sentences, min_words, long_words))
    return list(zip(zip(h1, h2), i, j))


_RUN = "k_id long, k_text long, h1 long, h2 int, i int, j int"


def sentence_runs(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                  long_words: int = LONG_WORDS) -> DataFrame:
    """All runs of ``docs(k_id, k_text, text)`` with their hash."""
    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, b.num_rows, _ROWS):
                row, *rest = _runs(b.column(2).slice(at, _ROWS).to_pylist(), min_sentences,
                                   min_words, long_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + at]), pa.array(texts[row + at]),
                     *(pa.array(x) for x in rest)],
                    names=["k_id", "k_text", "h1", "h2", "i", "j"])
    return docs.mapInArrow(run, _RUN)


def repeated_runs(found: DataFrame) -> DataFrame:
    """``(k_id, k_text, i, j)`` of every run that is not the first of its hash."""
    # bits enough that few runs pass by chance; the whole hash decides below
    short = F.shiftright("h1", 16).alias("g")
    often = (found.groupBy(short).agg(F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") > 1).select("g"))
    met = save(found.select("*", short).join(save(often, "often"), "g").drop("g"), "runs")
    place = F.struct("k_id", "k_text", "i")
    first = (met.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p"))
                .where(F.col("n") > 1)
                .select("h1", "h2", F.col("p.k_id").alias("f_id"),
                        F.col("p.k_text").alias("f_text"), F.col("p.i").alias("f_i")))
    return (met.join(save(first, "first-runs"), ["h1", "h2"])
               .where((F.col("k_id") != F.col("f_id")) | (F.col("k_text") != F.col("f_text"))
                      | (F.col("i") != F.col("f_i")))
               .select("k_id", "k_text", "i", "j"))


def _cut(docs: DataFrame, schema) -> DataFrame:
    """Take the marked sentences out of the text inside the row struct, some
    hundred texts at a time."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                rows, marks = part.column(ROW), part.column("_x_marks").to_pylist()
                new, n = [], []
                for t, m in zip(rows.field("text").to_pylist(), marks):
                    if not m:
                        new.append(t)
                        n.append(0)
                        continue
                    gone = set()
                    for x in m:
                        gone.update(range(x["i"], x["j"] + 1))
                    new.append("".join(p for k, p in enumerate(sentences(t)) if k not in gone))
                    n.append(len(gone))
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(new, pa.string()), pa.array(n, pa.int64())],
                    names=[ROW, "text", "n_removed"])
    return docs.mapInArrow(run, schema)


def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS,
                long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text``, and
    ``_x_removed``, the number of sentences removed."""
    text = F.col("text").cast("string")
    keyed = docs.withColumn("text", text).select(
        F.struct("*").alias(ROW),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(MAX_ID)).alias("k_id"),
        F.xxhash64("text").alias("k_text"))
    found = sentence_runs(keyed.select("k_id", "k_text", F.col(f"{ROW}.text")),
                          min_sentences, min_words, long_words)
    # a document's own runs, so bounded by its text; the set drops the
    # doubles that repeated rows bring
    marks = (repeated_runs(found).groupBy("k_id", "k_text")
             .agg(F.collect_set(F.struct("i", "j")).alias("_x_marks")))
    joined = keyed.join(marks, ["k_id", "k_text"], "left").select(ROW, "_x_marks")
    schema = joined.select(ROW, F.col(f"{ROW}.text"),
                           F.lit(0).cast("long").alias("n_removed")).schema
    cut = _cut(joined, schema)
    cols = [F.col("text") if c == "text" else F.col(f"{ROW}.`{c}`") for c in docs.columns]
    return cut.select(*cols, F.col("n_removed").alias("_x_removed"))
