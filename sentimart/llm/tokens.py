"""Edit-aware token counts (operator 3).

A document is cut into the tokenizer's pieces; runs of ``LEAF`` pieces are
the leaves of a segment tree that holds, per node, the characters, pieces
and tokens below it. An edit (position, characters deleted, text inserted)
finds its leaves by descending on characters, re-cuts and re-encodes only
the text of those leaves and updates the sums on the paths to the root.

Boundary context: whether a piece ends where it does depends on no more than
``LOOK_AHEAD`` characters after it, so the leaf that many characters before
the edit is re-cut too; to the right, re-cutting goes on, leaf by leaf, until
a piece ends where an old leaf ends. From there the rest of the text is cut
as before, since cutting never looks back.

``Tree`` is the structure for one document (plain lists, a few hundred bytes
a leaf). ``TreeStore`` keeps the trees of a corpus between batches of edits, as
a table of leaves with their token counts: a batch reads the trees of the
documents it edits, re-encodes the leaves it touches and writes those
documents' new trees; no other text is read again. ``count_after_edits``
edits texts that are at hand, one tree per row, in tasks, without a shuffle.

Columns: ``text`` and an array of edits; others are kept. Defined cases: null
and empty texts have an empty tree; positions beyond the text are cut to its
end and negative ones to its start; deletions stop at the end; null edits and
empty edits change nothing; an empty table gives an empty result; repeated
rows are counted alike.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentimart.llm.bpe import Pieces
from sentimart.llm.common import ROW
from sentimart.session import remove_dir, shared_dir

LEAF = 64            # pieces in a leaf when it is made
LOOK_AHEAD = 2       # characters after a piece that can change its end
EDITS = "array<struct<pos:int,n_del:int,ins:string>>"
_ROWS = 256


class Tree:
    """Segment tree over leaves of text with their token counts."""

    def __init__(self, text: str, find, pieces: Pieces):
        self.find, self.pieces = find, pieces
        self.recut_chars = 0
        self._build(self._leaves(text))

    @classmethod
    def of_leaves(cls, leaves: list[tuple[str, int]], find, pieces: Pieces) -> Tree:
        """A kept tree: nothing is cut or encoded."""
        tree = cls("", find, pieces)
        tree._build(leaves)
        return tree

    def leaves(self) -> list[tuple[str, int]]:
        return [(t, self.tokens[self.width + i]) for i, t in enumerate(self.text) if t]

    def _leaves(self, text: str) -> list[tuple[str, int]]:
        cut = self.find(text) if text else []
        return [("".join(p), self.pieces.count(p))
                for p in (cut[i:i + LEAF] for i in range(0, len(cut), LEAF))]

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.width = 1
        while self.width < len(leaves):
            self.width *= 2
        self.text = [t for t, _ in leaves] + [""] * (self.width - len(leaves))
        self.chars, self.tokens = [0] * 2 * self.width, [0] * 2 * self.width
        for i, (t, n) in enumerate(leaves, self.width):
            self.chars[i], self.tokens[i] = len(t), n
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` and where that leaf starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.width, start

    def edit(self, pos: int, n_del: int, ins: str) -> None:
        pos = min(max(pos, 0), self.n_chars)
        end = min(pos + max(n_del, 0), self.n_chars)
        if pos == end and not ins:
            return
        a, start = self._find(max(0, pos - LOOK_AHEAD - 1))
        b, _ = self._find(max(pos, end - 1))
        old = "".join(self.text[a:b + 1])
        old_end = start + len(old)
        text = old[:pos - start] + ins + old[end - start:]
        while True:
            if old_end >= self.n_chars:
                cut = self.find(text) if text else []
                break
            nxt = self._next(b)
            tail = self.text[nxt]
            if len(tail) > LOOK_AHEAD:
                # does a piece end where the next old leaf starts?
                cut, at = [], 0
                for p in self.find(text + tail[:LOOK_AHEAD + 1]):
                    if at >= len(text):
                        break
                    cut.append(p)
                    at += len(p)
                if at == len(text):
                    break
            text, b, old_end = text + tail, nxt, old_end + len(tail)
        self.recut_chars += len(text)
        leaves = [("".join(p), self.pieces.count(p))
                  for p in (cut[i:i + LEAF] for i in range(0, len(cut), LEAF))]
        if len(leaves) > b - a + 1:
            self._grow(a, b, leaves)
            return
        leaves += [("", 0)] * (b - a + 1 - len(leaves))
        for i, (t, n) in enumerate(leaves, a):
            self.text[i] = t
            self.chars[self.width + i], self.tokens[self.width + i] = len(t), n
        lo, hi = (self.width + a) // 2, (self.width + b) // 2
        while lo:
            for i in range(lo, hi + 1):
                self._sum(i)
            lo, hi = lo // 2, hi // 2

    def _next(self, b: int) -> int:
        b += 1
        while not self.chars[self.width + b]:
            b += 1
        return b

    def _grow(self, a: int, b: int, leaves: list[tuple[str, int]]) -> None:
        """More leaves than places: lay the leaves out anew, no re-encoding."""
        own = [(t, self.tokens[self.width + i]) for i, t in enumerate(self.text)]
        self._build([x for x in own[:a] + leaves + own[b + 1:] if x[0]])


def count_after_edits(docs: DataFrame, ranks: Broadcast, pattern: str, text: str = "text",
                      edits: str = "edits") -> DataFrame:
    """``docs`` with ``tokens_before``, ``tokens_after`` and ``chars_recut``
    (characters cut and encoded again) in one struct column ``counts``."""
    packed = docs.select(F.struct("*").alias(ROW), F.col(text).cast("string").alias("_x_text"),
                         F.col(edits).cast(EDITS).alias("_x_edits"))
    out = packed.select(ROW, *[F.lit(0).cast("long").alias(c)
                               for c in ("before", "after", "recut")])

    names, schema = out.columns, out.schema

    def run(batches):
        find, pieces = regex.compile(pattern).findall, Pieces(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part, rows = b.slice(at, _ROWS), []
                for t, changes in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tree = Tree(t or "", find, pieces)
                    before = tree.n_tokens
                    for e in changes or ():
                        if e is not None:
                            tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
                    rows.append((before, tree.n_tokens, tree.recut_chars))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows))],
                    names=names)

    done = packed.mapInArrow(run, schema)
    return done.select(f"{ROW}.*", F.struct(F.col("before").alias("tokens_before"),
                                            F.col("after").alias("tokens_after"),
                                            F.col("recut").alias("chars_recut")).alias("counts"))


LEAVES = "array<struct<text: string, tokens: bigint>>"
_LEAVES = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())]))
_TREES = f"doc_id long, leaves {LEAVES}, n_tokens long, n_chars long, before long, recut long"


class TreeStore:
    """Segment trees of a corpus, kept in a folder of the shared storage.

    ``<folder>/batch=<k>/part=<p>`` holds the trees that batch ``k`` wrote, of
    the documents whose id hashes to ``p``; a document's last batch counts.
    Batch 0 are the whole texts. ``apply`` opens the parts that the edited
    documents are in (part folders are pruned), finds each one's last batch
    from the columns without text, and joins the edits to those trees only.
    Writing a batch again replaces it, so a failed one can be repeated.

    Documents need distinct ids; rows without an id are left out, several rows
    of one id or several edit rows of one document in a batch raise. Edits of
    unknown documents make new ones."""

    def __init__(self, spark: SparkSession, ranks: Broadcast, pattern: str,
                 folder: str | None = None, parts: int = 64):
        self.spark, self.ranks, self.pattern = spark, ranks, pattern
        self.folder = folder or shared_dir(spark, "trees")
        self.parts, self.batches = parts, 0

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int")

    def _grown(self, rows: DataFrame) -> DataFrame:
        """Trees of ``(doc_id, text, leaves, edits)``: of the leaves, or of the
        text where there are none."""
        pattern, ranks = self.pattern, self.ranks

        def run(batches):
            find, pieces = regex.compile(pattern).findall, Pieces(ranks.value)
            for b in batches:
                for at in range(0, b.num_rows, _ROWS):
                    part, out = b.slice(at, _ROWS), []
                    for t, leaves, edits in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                        tree = (Tree(t or "", find, pieces) if leaves is None else
                                Tree.of_leaves([(x["text"], x["tokens"]) for x in leaves], find, pieces))
                        before = tree.n_tokens
                        for e in edits or ():
                            if e is not None:
                                tree.edit(e["pos"] or 0, e["n_del"] or 0, e["ins"] or "")
                        out.append(([{"text": x, "tokens": n} for x, n in tree.leaves()], tree.n_tokens,
                                    tree.n_chars, before, tree.recut_chars))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), *(pa.array(c, k) for c, k in zip(
                            zip(*out), [_LEAVES, *[pa.int64()] * 4]))],
                        names=["doc_id", "leaves", "n_tokens", "n_chars", "before", "recut"])
        return rows.select("doc_id", "text", "leaves", "edits").mapInArrow(run, _TREES)

    def _write(self, rows: DataFrame) -> None:
        (self._grown(rows).withColumn("part", self._part()).write.mode("overwrite")
             .option("partitionOverwriteMode", "static").partitionBy("part")
             .parquet(f"{self.folder}/batch={self.batches}"))
        self.batches += 1

    def _table(self) -> DataFrame:
        kept = self.spark.read.schema(_TREES + ", batch int, part int").parquet(self.folder)
        return kept.where(F.col("batch") < self.batches)

    def _distinct(self, rows: DataFrame, what: str) -> DataFrame:
        """Raises for an id that comes twice, while the rows are read."""
        twice = F.raise_error(F.concat(F.lit(f"several {what} of one document: "),
                                       F.col("doc_id").cast("string")))
        n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
        return rows.withColumn("_n", n).where(F.when(F.col("_n") > 1, twice.cast("boolean"))
                                               .otherwise(True)).drop("_n")

    def create(self, docs: DataFrame) -> None:
        """Batch 0: the trees of whole texts."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
        rows = self._distinct(rows.where(F.col("doc_id").isNotNull()), "rows")
        self.batches = 0
        self._write(rows.withColumn("leaves", F.lit(None).cast(LEAVES))
                        .withColumn("edits", F.lit(None).cast(EDITS)))

    def apply(self, edits: DataFrame) -> DataFrame:
        """One batch ``(doc_id, edits)``; returns ``doc_id, tokens_before,
        tokens_after, chars_recut, chars`` of the edited documents."""
        edits = self._distinct(edits.select(F.col("doc_id").cast("long").alias("doc_id"),
                                            F.col("edits").cast(EDITS).alias("edits"))
                                    .where(F.col("doc_id").isNotNull()), "edit rows")
        # at most as many numbers as the store has parts
        parts = [r.p for r in edits.select(self._part().alias("p")).distinct().collect()]
        kept = self._table().where(F.col("part").isin(parts))
        last = (kept.select("doc_id", "batch").join(edits.select("doc_id"), "doc_id", "left_semi")
                    .groupBy("doc_id").agg(F.max("batch").alias("batch")))
        trees = kept.select("doc_id", "batch", "leaves").join(last, ["doc_id", "batch"]).drop("batch")
        self._write(edits.join(trees, "doc_id", "left").withColumn("text", F.lit("")))
        return (self._table().where(F.col("batch") == self.batches - 1)
                    .select("doc_id", F.col("before").alias("tokens_before"),
                            F.col("n_tokens").alias("tokens_after"),
                            F.col("recut").alias("chars_recut"), F.col("n_chars").alias("chars")))

    def counts(self) -> DataFrame:
        """``(doc_id, n_tokens, n_chars)`` after all batches; no text is read."""
        now = F.max(F.struct("batch", "n_tokens", "n_chars")).alias("x")
        return (self._table().groupBy("doc_id").agg(now)
                    .select("doc_id", F.col("x.n_tokens").alias("n_tokens"), F.col("x.n_chars").alias("n_chars")))

    def texts(self) -> DataFrame:
        """``(doc_id, text)`` after all batches."""
        last = self._table().groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return (self._table().join(last, ["doc_id", "batch"])
                    .select("doc_id", F.array_join(F.col("leaves.text"), "").alias("text")))

    def close(self) -> None:
        remove_dir(self.spark, self.folder)
