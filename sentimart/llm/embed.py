"""Embedding near-dedup by spherical-cap filters (operator 10).

A filter is a direction; a vector belongs to the filters whose inner product
with it exceeds a bound, so two vectors at a small angle share filters and
two unrelated ones hardly ever do. The directions are structured random
product codes: the coordinates are turned by a random rotation and cut into
blocks, each with its own random unit vectors ("words"), and a direction is
one word per block. A code has words ** blocks directions, but a vector lists
the ones it exceeds block by block (list decoding): a beginning goes on only
with the words that can still pass the bound. Independent codes, ``CODES`` of
two blocks or as many more for each further block, even out how many
directions a vector exceeds.

1. Equal vectors count once. Vectors that are null, zero, or hold null or
   non-finite components are set aside.
2. The number of directions follows the number of vectors, so that a filter
   holds about ``OCCUPANCY`` unrelated vectors at any size. A block has at
   most ``MAX_WORDS`` words; more directions take more blocks. A code's bound
   is the one that gives a vector ``PER_CODE`` filters on average, fitted per
   vector length on ``SAMPLE`` vectors at most; all vectors are then decoded.
   A code is made from its numbers wherever it is used: what travels is a
   table of one row per vector length, joined by length.
3. Vectors meet per filter. A filter with more than ``BLOCK`` vectors is cut
   into chunks, and every pair of chunks is a group of its own: all pairs
   are looked at, and no task holds more than two chunks. The exact cosine
   in double precision decides.
4. A group gives one row per linked vector: how many vectors it links with,
   and the least vector that the group's links lead to. A pair that shares
   several filters is counted in the first of them: vectors travel with
   their earlier filters. So the links of a group of near copies are counted
   but never written out.
5. Components of the rows (vector, least vector), counts with the copies.

Recall is not exact: tests measure it on the hardest pairs, those at the
threshold. By the codes that tables of 64 components would get (24 codes of
three blocks, measured on 300 such pairs): at 10^5 vectors 1.00 of them share
a filter, at 10^6 and 10^8 0.997, at 10^10 (four blocks) at least 0.94.

Columns: ``vec_id`` and ``embedding``; others are ignored. Defined cases:
repeated rows are separate vectors that link with each other; rows with a
null id have no component and are not kept, but count as links of others;
vectors link within their own length only; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimart.llm.common import save, shuffle_partitions
from sentimart.llm.graph import connected_components, with_least

THRESHOLD = 0.95     # contract
CODES = 12           # independent product codes for each block but the first
PER_CODE = 4         # filters of a vector in each, on average
OCCUPANCY = 1        # unrelated vectors in a filter
MAX_WORDS = 1024     # words of a block
SAMPLE = 400         # vectors of a length that fit the bound
BLOCK = 512          # vectors of a filter that are paired at a time
SEED = 7


class ProductCode:
    """Random product code over ``dim`` coordinates, the same wherever it is
    made from the same numbers."""

    def __init__(self, dim: int, words: int, blocks: int, number: int, bound: float = -1.0,
                 seed: int = SEED):
        rng = np.random.default_rng([seed, dim, words, number])
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.words, self.blocks, self.number, self.bound = words, blocks, number, bound
        # fewer coordinates than blocks: some blocks are empty
        self.cuts = np.array_split(np.arange(dim), blocks)
        self.codes = []
        for c in self.cuts:
            w = rng.normal(size=(words, len(c)))
            self.codes.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300))

    def products(self, x: np.ndarray) -> list[np.ndarray]:
        """Inner products with each block's words, for unit rows ``x``."""
        y = x @ self.turn
        return [y[:, c] @ w.T / np.sqrt(self.blocks) for c, w in zip(self.cuts, self.codes)]

    def fit(self, sample: np.ndarray, per_code: float) -> None:
        """Set the bound that ``per_code`` directions exceed on average over
        the sample: down from the best direction, then by halving."""
        if per_code >= self.words ** self.blocks:
            return
        products = self.products(sample)

        def mean_size(bound: float) -> float:
            return float(np.mean([len(self._decode(row, bound)) for row in zip(*products)]))

        high = low = float(sum(p.max(axis=1) for p in products).max())
        step = abs(high) * 0.05 + 1e-9
        while mean_size(low) < per_code:
            high, low = low, low - step
        for _ in range(10):
            mid = (low + high) / 2
            if mean_size(mid) < per_code:
                high = mid
            else:
                low = mid
        self.bound = low

    def _decode(self, row: tuple[np.ndarray, ...], bound: float) -> np.ndarray:
        """All directions whose inner product exceeds ``bound``."""
        best = [float(p.max()) for p in row]
        total, number = np.zeros(1), np.zeros(1, np.int64)
        for k, p in enumerate(row):
            order = np.argsort(-p)
            # words that the best of the later blocks can still bring over the bound
            n = np.searchsorted(-p[order], total + (sum(best[k + 1:]) - bound))
            word = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            total = np.repeat(total, n) + p[order][word]
            number = np.repeat(number, n) * self.words + order[word]
        return number

    def filters(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter numbers of each row of ``x``."""
        base = self.number * self.words ** self.blocks
        return [base + self._decode(row, self.bound) for row in zip(*self.products(x))]


def code_shape(count: int, per_code: float, max_words: int) -> tuple[int, int]:
    """Words and blocks of a code for ``count`` vectors."""
    directions = max(4.0, count * per_code / OCCUPANCY)
    blocks = 2
    while directions ** (1 / blocks) > max_words:
        blocks += 1
    return max(2, round(directions ** (1 / blocks))), blocks


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = rows.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row borders of an array column without nulls."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return (column.flatten().to_numpy(zero_copy_only=False),
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))


def code_books(vectors: DataFrame, codes: int, per_code: float, max_words: int) -> DataFrame:
    """``(dim, words, blocks, bounds)`` for every length of ``vectors(v, x)``."""
    sized = vectors.select(F.size("x").alias("dim"), "x", F.xxhash64("v").alias("place"))
    counts = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("count"))
    place = F.row_number().over(Window.partitionBy("dim").orderBy("place"))
    sample = sized.withColumn("place", place).where(F.col("place") <= SAMPLE)

    def fit(key, rows):
        import pandas as pd
        dim = int(key[0])
        x = _unit(np.stack(rows["x"].to_list()))
        words, blocks = code_shape(int(rows["count"].iloc[0]), per_code, max_words)
        bounds = []
        for number in range(codes * (blocks - 1)):
            code = ProductCode(dim, words, blocks, number)
            code.fit(x, per_code)
            bounds.append(code.bound)
        return pd.DataFrame({"dim": [dim], "words": [words], "blocks": [blocks],
                             "bounds": [bounds]})

    return sample.join(counts, "dim").groupBy("dim").applyInPandas(
        fit, "dim int, words int, blocks int, bounds array<double>")


def vector_filters(vectors: DataFrame, books: DataFrame) -> DataFrame:
    """``(dim, v, n, x, filters)``: the filters of every row of
    ``vectors(v, n, x)``, in rising order."""
    def run(batches):
        codes: dict[int, list[ProductCode]] = {}
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                if dim not in codes:
                    if len(codes) == 4:     # many lengths: hold a few at a time
                        codes.clear()
                    first = {c: part.column(c)[0].as_py() for c in ("words", "blocks", "bounds")}
                    codes[dim] = [ProductCode(dim, first["words"], first["blocks"], k, bound)
                                  for k, bound in enumerate(first["bounds"])]
                x = _unit(_flat(part.column("x"))[0].reshape(-1, dim))
                found = [got for code in codes[dim] for got in code.filters(x)]
                row = np.repeat(np.arange(len(found)) % len(x), [len(g) for g in found])
                numbers = np.concatenate(found)
                order = np.lexsort((numbers, row))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 pa.array(numbers[order], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("dim", "v", "n", "x")), lists],
                    names=["dim", "v", "n", "x", "filters"])

    sized = vectors.select(F.size("x").alias("dim"), "v", "n", "x").join(books, "dim")
    kind = vectors.schema["x"].dataType.simpleString()
    return sized.mapInArrow(run, f"dim int, v long, n long, x {kind}, filters array<long>")


def _near(x: np.ndarray, own: np.ndarray, p: int, q: int, threshold: float) -> np.ndarray:
    """Which vectors of a group link: within a chunk, or between two."""
    if p == q:
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        return near
    left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
    across = x[left] @ x[right].T >= threshold
    near = np.zeros((len(x), len(x)), bool)
    near[np.ix_(left, right)] = across
    near[np.ix_(right, left)] = across.T
    return near


def _met_before(earlier: list[np.ndarray]) -> np.ndarray:
    """Which pairs of vectors share one of their earlier filters."""
    row = np.repeat(np.arange(len(earlier)), [len(e) for e in earlier])
    known, column, n = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[column]    # those held once link no pair
    met = np.zeros((len(earlier), len(earlier)), bool)
    for lo in range(0, int((n > 1).sum()), 2048):
        here = (column >= lo) & (column < lo + 2048)
        holds = np.zeros((len(earlier), 2048), np.float32)
        holds[row[here], column[here] - lo] = 1
        met |= holds @ holds.T > 0
    return met


def _roots(near: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least vector that each one's links lead to."""
    root, seen = v.copy(), np.zeros(len(v), bool)
    for start in np.argsort(v):
        edge = np.array([start]) if not seen[start] else np.array([], np.int64)
        while len(edge):
            seen[edge], root[edge] = True, v[start]
            edge = np.flatnonzero(near[edge].any(axis=0) & ~seen)
    return root


def verify(met: DataFrame, threshold: float) -> DataFrame:
    """``(v, others, root)`` per linked vector and group, of rows
    ``(dim, filter, p, q, own, v, n, x, earlier)`` that come sorted by group; a group
    has at most two chunks, so little is held at a time."""
    keys = ("dim", "filter", "p", "q")

    def linked(parts, tag):
        v, n, own, x = (np.concatenate(c) for c in list(zip(*parts))[:4])
        near = _near(_unit(x), own, tag[2], tag[3], threshold)
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            return None
        near = near[np.ix_(rows, rows)]
        earlier = [e for part in parts for e in part[4]]
        fresh = near & ~_met_before([earlier[r] for r in rows])
        return v[rows], fresh @ n[rows], _roots(near, v[rows])

    def run(batches):
        held, tag = [], None
        for b in batches:
            group = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                              for c in keys])
            own, v, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("own", "v", "n"))
            x, at = _flat(b.column("x"))
            filters, begin = _flat(b.column("earlier"))
            new = np.flatnonzero((np.diff(group) != 0).any(axis=0)) + 1
            edges = [0, *new.tolist(), b.num_rows] if b.num_rows else []
            found = []
            for lo, hi in zip(edges, edges[1:]):
                here = tuple(group[:, lo].tolist())
                if here != tag and held:
                    found.append(linked(held, tag))
                    held.clear()
                tag = here
                held.append((v[lo:hi], n[lo:hi], own[lo:hi],
                             x[at[lo]:at[hi]].reshape(hi - lo, -1),
                             [filters[begin[i]:begin[i + 1]] for i in range(lo, hi)]))
            if any(f is not None for f in found):
                yield _rows(found)
        if held and (last := linked(held, tag)) is not None:
            yield _rows([last])

    return met.mapInArrow(run, "v long, others long, root long")


def _rows(found: list) -> pa.RecordBatch:
    columns = zip(*(f for f in found if f is not None))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns],
                                      names=["v", "others", "root"])


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, codes: int = CODES,
                 per_code: float = PER_CODE, max_words: int = MAX_WORDS) -> DataFrame:
    """``(v, others, root)`` of distinct ``vectors(v, n, x)`` with their numbers
    of copies ``n``: a vector's ``others`` add up to the copies it links with
    at a cosine of ``threshold`` or more; the links (v, root) join what links join."""
    books = save(code_books(vectors, codes, per_code, max_words), "code-books")
    lists = save(vector_filters(vectors, books), "filters")
    spots = lists.select("dim", "v", F.posexplode("filters").alias("place", "filter"))
    chunks = F.ceil(F.col("count") / BLOCK).cast("int")
    shared = (spots.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("count"))
                   .where(F.col("count") > 1).select("dim", "filter", chunks.alias("chunks")))
    own = F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int")
    members = spots.join(shared, ["dim", "filter"]).withColumn("own", own)
    groups = members.select(
        "dim", "filter", "v", "place", "own",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    groups = groups.select("dim", "filter", F.least("own", "other").alias("p"),
                           F.greatest("own", "other").alias("q"), "own", "v", "place")
    met = (groups.join(lists.select("v", "n", "x", "filters"), "v")
                 .select("dim", "filter", "p", "q", "own", "v", "n", "x",
                         F.slice("filters", F.lit(1), F.col("place")).alias("earlier"))
                 .repartition(shuffle_partitions(vectors.sparkSession), "dim", "filter", "p", "q")
                 .sortWithinPartitions("dim", "filter", "p", "q"))
    return verify(met, threshold)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD,
                    max_words: int = MAX_WORDS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``rows``."""
    kind = rows.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    x = F.col("embedding").cast(kind)
    good = (x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
            & F.exists(x, lambda e: e != 0))
    # -0.0 and 0.0 are equal components
    plain = F.transform(x, lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e)).cast(kind)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.when(F.coalesce(good, F.lit(False)), plain).alias("x"))
    base = save(base.select("vec_id", "x", F.xxhash64("x").alias("v")), "vectors")
    whole = base.where(F.col("x").isNotNull())
    # copies count once; a vector is known by its 64-bit hash from here on
    distinct = save(whole.groupBy("x").agg(F.min("vec_id").alias("first"),
                                           F.count(F.lit(1)).alias("n"))
                         .select(F.xxhash64("x").alias("v"), "x", "first", "n"),
                    "distinct-vectors")
    links = save(vector_links(distinct.select("v", "n", "x"), threshold, max_words=max_words),
                 "vector-links")
    others = links.groupBy("v").agg(F.sum("others").alias("others"))
    labels = save(connected_components(links.select(F.col("v").alias("a"),
                                                    F.col("root").alias("b"))), "vector-labels")
    named = labels.join(distinct.select(F.col("v").alias("node"), "first"), "node")
    linked = (with_least(named, "label", "first", "node")
              .select(F.col("node").alias("v"), F.col("least")))
    of = save(distinct.select("v", "n", "first").join(others, "v", "left").join(linked, "v", "left")
              .select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
                      F.coalesce("least", "first").alias("component")), "vector-components")
    key = F.when(F.col("x").isNotNull(), F.col("v")).alias("v")
    out = base.select("vec_id", key).join(of, "v", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
