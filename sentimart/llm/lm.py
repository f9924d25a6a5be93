"""Stupid-backoff language-model scores, computed relationally (operator 9).

N-grams are runs of ``order`` consecutive byte-level BPE tokens (start symbols
before the first): the vocabulary is open, as every text has tokens, and
bounded. A gram is packed in one long; an order that does not fit is refused.

1. Every text is encoded and its grams of all orders are counted, summed up
   over a batch of texts before they leave the task. The count tables are
   partitioned by the gram's hash and saved, once.
2. Every text is encoded again to its distinct grams. The ``FREQUENT`` most
   frequent grams of the corpus (a fixed number, so they may be broadcast) are
   scored right there: they are most of all occurrences, and with them the
   grams that most documents hold leave no hot key behind. All other grams
   meet the count table in a hash join, one row per document and gram.
3. A gram that only its own document holds backs off: the row goes on with its
   last tokens to the table of the next lower order, at last to the single
   tokens (at most one row per vocabulary entry, so they may be broadcast).
4. Contributions are summed per document, map-side first.

A document is scored by what the rest of the corpus holds: with c the counts
and the document's own occurrences taken off both, a token w after the context
v scores (c(vw) - own) / (c(v) - own) if the first is positive, else ``BACKOFF``
times its score after the context less its first token, at last c(w) / N over
all N tokens. ``log_score`` is the sum of natural logarithms, ``n_backoff`` the
number of tokens that did not score at the full order.

Columns: ``doc_id`` and ``text``; others are ignored. Defined cases: null and
empty texts have no grams and score 0 in total and null on average; rows with
the same id are one document, its occurrences are those of all its rows; every
row without an id is a document of its own; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentimart.llm.common import save

BACKOFF = 0.4          # the method's constant
ORDER = 2
FREQUENT = 262_144     # grams scored where they occur
_ROWS = 256            # texts in one result batch
_COUNTED = 2_048       # texts whose counts are summed before they leave the task
_BUCKETS = 1 << 20     # marks of ids that occur more than once


def symbol_bits(ranks: dict[bytes, int], order: int) -> tuple[int, int]:
    """The start symbol (behind the last id) and the bits of a symbol."""
    start = max(ranks.values(), default=-1) + 1
    bits = max(1, start.bit_length())
    if order < 2:
        raise ValueError(f"order must be 2 or more, got {order}")
    if order * bits > 62:
        raise ValueError(f"{order} tokens of {bits} bits do not fit in a long")
    return start, bits


class Grams:
    """Distinct grams of a text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, order: int):
        self.encoding = tiktoken.Encoding("grams", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={})
        self.order = order
        self.start, self.bits = symbol_bits(ranks, order)

    def packed(self, text: str | None) -> np.ndarray:
        """The gram of full order that ends in each token."""
        first = [self.start] * (self.order - 1)
        ids = np.array([*first, *self.encoding.encode_ordinary(text or "")], np.int64)
        n = len(ids) - self.order + 1
        out = np.zeros(n, np.int64)
        for k in range(self.order):
            out = out << self.bits | ids[k:k + n]
        return out

    def last(self, grams: np.ndarray, order: int) -> np.ndarray:
        return grams & ((1 << self.bits * order) - 1)

    def distinct(self, text: str | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct grams, and for each its occurrences in the text followed by
        those of its context, for the full order and every lower one."""
        grams, n = np.unique(self.packed(text), return_counts=True)

        def total(x: np.ndarray) -> np.ndarray:
            _, place = np.unique(x, return_inverse=True)
            return np.bincount(place, weights=n, minlength=1).astype(np.int64)[place]

        own = []
        for o in range(self.order, 1, -1):
            g = self.last(grams, o)
            own += [n if o == self.order else total(g), total(g >> self.bits)]
        return grams, own


def _own_names(order: int) -> list[str]:
    return [f"{x}{o}" for o in range(order, 1, -1) for x in ("own", "ctx")]


def gram_counts(docs: DataFrame, ranks: Broadcast, pattern: str, order: int) -> DataFrame:
    """The count tables ``(o, gram, c)`` of all texts, for orders 2 and up."""
    def run(batches):
        grams = Grams(ranks.value, pattern, order)
        for b in batches:
            for at in range(0, b.num_rows, _COUNTED):
                found = [grams.packed(t) for t in b.column(0).slice(at, _COUNTED).to_pylist()]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                for o in range(order, 1, -1):
                    if o < order:
                        gram, place = np.unique(grams.last(gram, o), return_inverse=True)
                        n = np.bincount(place, weights=n, minlength=len(gram))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(gram), o, np.int32)), pa.array(gram),
                         pa.array(n.astype(np.int64))], names=["o", "gram", "n"])
    return (docs.select(F.col("text").cast("string")).mapInArrow(run, "o int, gram long, n long")
                .groupBy("o", "gram").agg(F.sum("n").alias("c")))


class Tables:
    """Count tables by order, read from one saved table."""

    def __init__(self, counts: DataFrame, bits: int):
        self.counts, self.bits = counts, bits

    def shifted(self, c: Column | str) -> Column:
        return F.shiftright(c, self.bits)

    def of(self, o: int) -> DataFrame:
        """``(gram, c, c_ctx)``: count of the gram and of its context."""
        grams = self.counts.where(F.col("o") == o).select("gram", "c")
        grams = grams.withColumn("v", self.shifted("gram"))
        context = grams.groupBy("v").agg(F.sum("c").alias("c_ctx"))
        # contexts of pairs are single symbols, no more than the vocabulary has
        return grams.join(F.broadcast(context) if o == 2 else context, "v").drop("v")

    def tokens(self, backoff: float, order: int) -> DataFrame:
        """``(w, log_w)``: logarithm of the score at the lowest order."""
        w = F.col("gram").bitwiseAND(F.lit((1 << self.bits) - 1))
        tokens = (self.counts.where(F.col("o") == 2).groupBy(w.alias("w"))
                      .agg(F.sum("c").alias("c_w")))
        total = F.sum("c_w").over(Window.partitionBy())
        return tokens.select("w", F.log(F.lit(backoff ** (order - 1)) * F.col("c_w") / total)
                                   .alias("log_w"))


def _document_grams(docs: DataFrame, ranks: Broadcast, pattern: str, order: int,
                    frequent: Broadcast, marks: Broadcast, repeated: bool) -> DataFrame:
    """``(doc, apart, gram, n, own.., score)`` of the texts. Grams that are
    scored here are in one row per text, with their number and score and a
    negative gram (spread by the text's place in the batch); texts whose id is
    marked as repeated are left out, or taken alone and not scored here."""
    names = _own_names(order)

    def run(batches):
        grams = Grams(ranks.value, pattern, order)
        keys, count, context = frequent.value
        marked = marks.value
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                row, gram, score = [], [], []
                own: list[list[np.ndarray]] = [[] for _ in names]
                bucket = part.column(2).to_pylist()
                for k, t in enumerate(part.column(3).to_pylist()):
                    if (bucket[k] in marked) != repeated:
                        continue
                    g, o = grams.distinct(t)
                    done, total = np.zeros(len(g), bool), 0.0
                    if len(keys) and not repeated:
                        at_key = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                        left = count[at_key] - o[0]
                        done = (keys[at_key] == g) & (left > 0)
                        total = float((o[0] * np.log(np.where(done, left / np.where(
                            done, context[at_key] - o[1], 1), 1.0))).sum())
                    rest = ~done
                    n_done = int(o[0][done].sum())
                    row.append(np.full(int(rest.sum()) + 1, k))
                    gram.append(np.r_[-1 - (at + k), g[rest]])
                    score.append(np.r_[total, np.zeros(int(rest.sum()))])
                    for i, x in enumerate(o):
                        own[i].append(np.r_[n_done if i == 0 else 0, x[rest]])
                if row:
                    place = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(place), part.column(1).take(place),
                         pa.array(np.concatenate(gram)),
                         *(pa.array(np.concatenate(x).astype(np.int64)) for x in own),
                         pa.array(np.concatenate(score))],
                        names=["doc", "apart", "gram", *names, "score"])

    return docs.mapInArrow(run, "doc long, apart boolean, gram long, "
                           + ", ".join(f"{x} long" for x in names) + ", score double")


def _merged(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """Grams of documents with several rows: occurrences of all their rows."""
    names = _own_names(order)
    top = names[0]
    key = ["doc", "apart"]
    out = rows.groupBy(*key, "gram").agg(F.sum(top).alias(top), F.sum("score").alias("score"))
    known = F.col("gram") >= 0
    for o in range(order, 1, -1):
        gram = F.col("gram").bitwiseAND(F.lit((1 << bits * o) - 1))
        for name, g in ((f"own{o}", gram), (f"ctx{o}", F.shiftright(gram, bits))):
            if name != top:
                all_of = F.sum(top).over(Window.partitionBy(*key, known, g))
                out = out.withColumn(name, F.when(known, all_of).otherwise(0))
    return out.select(*key, "gram", *names, "score")


def _scored(rows: DataFrame, tables: Tables, o: int, order: int, backoff: float) -> DataFrame:
    """``(doc, apart, n, n_backoff, part)`` from rows at order ``o``."""
    n = F.col(f"own{order}") if o == order else F.col("n")
    rows = rows.withColumn("n", n.cast("long"))
    met = rows.join(tables.of(o).hint("shuffle_hash"), "gram", "left")
    seen = F.col("c") - F.col(f"own{o}")
    found = F.col("n") * (F.log(seen.cast("double")) - F.log((F.col("c_ctx") - F.col(f"ctx{o}")).cast("double"))
                          + F.lit((order - o) * np.log(backoff)))
    below = F.when(F.col("gram") >= 0, seen <= 0).otherwise(False)
    missed = F.when(F.lit(o == order) & below, F.col("n")).otherwise(0)
    if o > 2:
        met = save(met.withColumn("below", below).withColumn("part", F.when(
            F.col("gram") < 0, F.col("score")).when(~below, found).otherwise(0.0))
            .withColumn("n_backoff", missed).drop("c", "c_ctx", "score"), "grams")
        here = met.select("doc", "apart", F.when(F.lit(o == order), F.col("n")).otherwise(0).alias("n"),
                          "n_backoff", "part")
        mask = F.lit((1 << tables.bits * (o - 1)) - 1)
        further = (met.where("below").withColumn("gram", F.col("gram").bitwiseAND(mask))
                      .withColumn("score", F.lit(0.0)).drop("below", "part", "n_backoff"))
        return here.unionByName(_scored(further, tables, o - 1, order, backoff)
                                .withColumn("n", F.lit(0).cast("long")))
    w = F.col("gram").bitwiseAND(F.lit((1 << tables.bits) - 1))
    met = (met.withColumn("w", F.when(below, w))
              .join(F.broadcast(tables.tokens(backoff, order)), "w", "left"))
    part = (F.when(F.col("gram") < 0, F.col("score"))
             .when(below, F.col("n") * F.col("log_w")).otherwise(found))
    return met.select("doc", "apart", "n", missed.cast("long").alias("n_backoff"), part.alias("part"))


def _frequent(tables: Tables, order: int, frequent: int) -> tuple[np.ndarray, ...]:
    """The most frequent grams, sorted, with their counts and their contexts'."""
    top = tables.of(order).orderBy(F.desc("c"), "gram").limit(frequent)
    x = np.array([tuple(r) for r in top.select("gram", "c", "c_ctx").collect()], np.int64)
    x = x.reshape(-1, 3)
    return tuple(x[np.argsort(x[:, 0])].T.copy())


def score(docs: DataFrame, ranks: Broadcast, pattern: str, backoff: float = BACKOFF,
          order: int = ORDER, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_tokens, n_backoff, log_score, mean_log_score``: one row for
    each id, and one for each row without an id."""
    sc = docs.sparkSession.sparkContext
    bits = symbol_bits(ranks.value, order)[1]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    tables = Tables(save(gram_counts(docs, ranks, pattern, order), "gram-counts"), bits)
    top = sc.broadcast(_frequent(tables, order, frequent))
    # ids of several rows, marked by a hash: a mark may also meet other ids,
    # which are then scored in the general way
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(_BUCKETS)).cast("int")
    again = (docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
                 .select(bucket.alias("b")).distinct())
    marks = sc.broadcast({r.b for r in again.collect()})   # _BUCKETS numbers at most
    # rows without an id: each text once, keyed by its hash
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("doc"), F.lit(False).alias("apart"), bucket.alias("b"), "text")
    nameless = docs.where(F.col("doc_id").isNull())
    alone = (nameless.select(text_key.alias("doc"), "text").dropDuplicates(["doc"])
                     .select("doc", F.lit(True).alias("apart"), F.lit(-1).alias("b"), "text"))
    texts = named.unionByName(alone)
    rows = _document_grams(texts, ranks, pattern, order, top, marks, False)
    if marks.value:
        several = _document_grams(named, ranks, pattern, order, top, marks, True)
        rows = rows.unionByName(_merged(several, order, bits).select(rows.columns))
    sums = (_scored(rows, tables, order, order, backoff).groupBy("doc", "apart").agg(
        F.sum("n").alias("n_tokens"), F.sum("n_backoff").alias("n_backoff"),
        F.sum("part").alias("log_score")))
    if nameless.isEmpty():
        out = sums.withColumn("doc_id", F.col("doc"))
    else:
        sums = save(sums, "scores")
        out = (sums.where("not apart").withColumn("doc_id", F.col("doc")).unionByName(
            nameless.select("doc_id", text_key.alias("doc"))
                    .join(sums.where("apart"), "doc").select(*sums.columns, "doc_id")))
    return out.select("doc_id", "n_tokens", "n_backoff", "log_score",
                      F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens"))
                       .alias("mean_log_score"))
