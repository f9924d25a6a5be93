"""Byte-level BPE encoding and decoding (operator 5).

A text is cut into pieces by the tokenizer's pattern; a piece's bytes are
merged pairwise, lowest rank first (leftmost on ties), until no pair has a
rank. Merging depends on the piece alone, so each task folds the merges once
per distinct piece and looks the others up; texts are never shuffled. The
rank map (a fixed vocabulary of some 50,000 entries, so its size is bounded)
is read once and sent to the executors. Decoding concatenates the binary
pieces of the ids.

``encode_words`` is the same fold written with Spark's higher-order
functions over a table of distinct words and a literal rank map, and
``decode_words`` its way back. Their lambdas are interpreted, see the README
for the rate; the queries use the task form.

Defined cases: a null text is an empty one (no ids, decodes to no bytes);
repeated rows give repeated rows; all further columns are kept, the results
are added as ``token_ids`` and ``decoded`` (a column of that name is
replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections.abc import Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE = 150_000    # distinct pieces of a generation; a task remembers two
ROOM = 24 << 20    # bytes of a generation's pieces and ids
_ROWS = 256        # texts in one result batch
_BYTES = 4 << 20   # bytes of texts or ids in one, unless a single one is longer
_LONG = 64         # bytes; longer pieces are merged over a heap
_KEPT = 256        # characters; longer pieces are not remembered
_NO_RANK = 1 << 62
_UNRANKED = 1 << 30  # as an int of Spark's


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank of every byte string of a vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: ranked merges over its bytes, lowest rank first,
    leftmost on ties."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > _LONG:
        return _merge_long(piece, ranks)
    rank = ranks.get
    part = [piece[i:i + 1] for i in range(len(piece))]
    found = [rank(piece[i:i + 2], _NO_RANK) for i in range(len(piece) - 1)]
    while found:
        lowest = min(found)
        if lowest == _NO_RANK:
            break
        i = found.index(lowest)
        part[i] += part.pop(i + 1)
        del found[i]
        if i < len(found):
            found[i] = rank(part[i] + part[i + 1], _NO_RANK)
        if i:
            found[i - 1] = rank(part[i - 1] + part[i], _NO_RANK)
    return [ranks[p] for p in part]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs: n log n for very long pieces (a page
    without white space)."""
    n = len(piece)
    part = [piece[i:i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, part[i] + part[i + 1]))
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i] if part[i] else n
        if j >= n or part[i] + part[j] != joined:
            continue      # one of the two has been merged meanwhile
        part[i], part[j] = joined, b""
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            r = ranks.get(joined + part[after[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, joined + part[after[j]]))
        if before[i] >= 0:
            r = ranks.get(part[before[i]] + joined)
            if r is not None:
                heapq.heappush(heap, (r, before[i], part[before[i]] + joined))
    return [ranks[p] for p in part if p]


class Pieces(dict):
    """Ids by piece, packed as 32-bit integers, folded on first use. At
    ``CACHE`` pieces or ``ROOM`` bytes a new generation begins, and the one
    before is asked first, so that frequent pieces stay. Very long pieces
    aren't kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.before, self.held = ranks, {}, 0

    def __missing__(self, piece: str) -> bytes:
        packed = self.before.get(piece)
        if packed is None:
            ids = merge(piece.encode("utf-8"), self.ranks)
            packed = struct.pack(f"<{len(ids)}i", *ids)
            if len(piece) > _KEPT:
                return packed
        if len(self) >= CACHE or self.held >= ROOM:
            self.before = None    # goes before the copy is made
            self.before = dict(self)
            self.clear()
            self.held = 0
        self[piece] = packed
        self.held += getsizeof(piece) + getsizeof(packed)
        return packed

    def count(self, pieces: list[str]) -> int:
        """Number of tokens of some pieces."""
        return sum(map(len, map(self.__getitem__, pieces))) // 4


def encode_text(text: str | None, find, pieces: Pieces) -> np.ndarray:
    """Ids of a text as 32-bit integers."""
    cut = find(text) if text else ()
    return np.frombuffer(b"".join(map(pieces.__getitem__, cut)), "<i4")


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """The rank map on every executor (as large as the vocabulary file)."""
    return spark.sparkContext.broadcast(load_ranks(path))


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``_ROWS`` rows or ``_BYTES`` bytes of column ``at``
    (texts, or lists of 32-bit ids) at most; a longer value is alone."""
    column = batch.column(at)
    if pa.types.is_list(column.type):
        sizes = pc.multiply(pc.list_value_length(column), 4)
    elif pa.types.is_null(column.type):
        sizes = column
    else:
        sizes = pc.binary_length(column)
    first = held = 0
    for k, n in enumerate(sizes.to_pylist()):
        n = n or 0
        if k > first and (k - first >= _ROWS or held + n > _BYTES):
            yield batch.slice(first, k - first)
            first, held = k, 0
        held += n
    if batch.num_rows:
        yield batch.slice(first)


def _with_results(df: DataFrame, ranks: Broadcast, added: list[str], source: str, make) -> DataFrame:
    """``df`` with the columns ``added`` (columns of those names are replaced).
    ``make(ranks)`` gives the function of a task from a list of ``source``
    values to the result columns."""
    empty = {"token_ids": F.array().cast("array<int>"), "decoded": F.lit(b"")}
    keep = [c for c in df.columns if c not in added]
    out = df.select(*[f"`{c}`" for c in keep], *[empty[c].alias(c) for c in added])
    at, schema = df.columns.index(source), out.schema
    index, names = [df.columns.index(c) for c in keep], [*keep, *added]

    def run(batches):
        convert = make(ranks.value)
        for b in batches:
            for part in _parts(b, at):
                results = convert(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in index), *results],
                                                 names=names)

    return df.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _bytes(ids, piece) -> pa.Array:
    return pa.array([b"".join(map(piece, x)) for x in ids], pa.binary())


def _encoder(pattern: str):
    def make(ranks):
        find, pieces = regex.compile(pattern).findall, Pieces(ranks)
        return lambda texts: [_lists([encode_text(t, find, pieces) for t in texts])]
    return make


def _decoder(ranks):
    piece = {i: p for p, i in ranks.items()}.__getitem__
    return lambda ids: [_bytes((x or () for x in ids), piece)]


def _round_trip(pattern: str):
    def make(ranks):
        find, pieces = regex.compile(pattern).findall, Pieces(ranks)
        piece = {i: p for p, i in ranks.items()}.__getitem__

        def both(texts):
            ids = [encode_text(t, find, pieces) for t in texts]
            return [_lists(ids), _bytes((x.tolist() for x in ids), piece)]
        return both
    return make


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids``, an array of int."""
    return _with_results(docs, ranks, ["token_ids"], text, _encoder(pattern))


def decode(df: DataFrame, ranks: Broadcast, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids (null ids: no bytes)."""
    return _with_results(df, ranks, ["decoded"], ids, _decoder)


def encode_decode(docs: DataFrame, ranks: Broadcast, pattern: str,
                  text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` and ``decoded``, the bytes of those ids, in
    one pass: a task holds one worker instead of two in a row."""
    return _with_results(docs, ranks, ["token_ids", "decoded"], text, _round_trip(pattern))


# --- the fold in higher-order functions --------------------------------------

def _rank_maps(ranks: dict[bytes, int]) -> tuple[Column, int]:
    """The literal rank map of hex strings, cut into one small map per
    checksum, as Spark searches a map from end to end; and their number."""
    n = max(1, len(ranks))
    parts: list[dict[str, int]] = [{} for _ in range(n)]
    for p, r in ranks.items():
        key = p.hex().upper()
        parts[zlib.crc32(key.encode()) % n][key] = r
    return F.from_json(F.lit(json.dumps(parts)), "array<map<string,int>>"), n


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_words(distinct: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """``distinct`` with ``token_ids``, by higher-order functions alone. The
    state of the fold is a word's parts and the ranks of its neighbouring
    pairs; a merge looks up the two pairs that it changes. The rank map is one
    literal, bound once."""
    hexed = F.hex(F.encode(F.col(word), "UTF-8"))
    n = (F.length(hexed) / 2).cast("int")
    maps, buckets = _rank_maps(ranks)
    none = F.array().cast("array<int>")

    def ids(maps: Column) -> Column:
        def rank(key: Column) -> Column:
            found = F.get(maps, (F.crc32(key) % buckets).cast("int"))[key]
            return F.coalesce(found, F.lit(_UNRANKED))

        def pieces(size: int) -> Column:
            return F.when(n >= size, F.transform(
                F.sequence(F.lit(0), n - size),
                lambda i: F.substring(hexed, 2 * i + 1, F.lit(2 * size)))
            ).otherwise(F.array().cast("array<string>"))

        def merged(part: Column, pair: Column, at: Column) -> Column:
            joined = F.concat(F.get(part, at - 1), F.get(part, at))
            left = F.when(at > 1, F.concat(
                F.slice(pair, F.lit(1), F.greatest(at - 2, F.lit(0))),
                F.array(rank(F.concat(F.get(part, at - 2), joined))))).otherwise(none)
            right = F.when(at < F.size(pair), F.concat(
                F.array(rank(F.concat(joined, F.get(part, at + 1)))),
                F.slice(pair, at + 2, F.size(pair)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(part, F.lit(1), at - 1), F.array(joined),
                         F.slice(part, at + 2, F.size(part))).alias("part"),
                F.concat(left, right).alias("pair"))

        def step(state: Column, _) -> Column:
            part, pair = state["part"], state["pair"]
            lowest = F.coalesce(F.array_min(pair), F.lit(_UNRANKED))
            at = F.array_position(pair, F.array_min(pair)).cast("int")
            return F.when(lowest == _UNRANKED, state).otherwise(
                _bind(at, lambda at: merged(part, pair, at)))

        start = F.struct(pieces(1).alias("part"), F.transform(pieces(2), rank).alias("pair"))
        folded = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none), start, step,
                             lambda state: F.transform(state["part"], rank))
        return _bind(rank(hexed), lambda whole: F.when(whole != _UNRANKED, F.array(whole))
                                                 .otherwise(folded))

    return distinct.withColumn("token_ids", _bind(maps, ids))


def decode_words(df: DataFrame, ranks: dict[bytes, int], ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``: the binary pieces of the ids, concatenated by
    higher-order functions over a literal array of the vocabulary."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for p, r in ranks.items():
        pieces[r] = p.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    none = F.array().cast("array<int>")
    return df.withColumn("decoded", _bind(table, lambda t: F.unhex(F.array_join(
        F.transform(F.coalesce(F.col(ids), none), lambda i: F.get(t, i)), ""))))
