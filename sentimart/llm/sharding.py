"""Sharding by Karmarkar-Karp differencing (operator 2).

Groups of equal texts are indivisible; shards get near equal bytes. A
partial partition is a tuple of ``shards`` sums. Differencing combines the
two partial partitions with the largest spread (largest minus smallest sum),
one in descending and one in ascending order, until one is left.

Spread over the cluster in levels, each the same algorithm:

1. groups smaller than the total / (shards x ``BIG``) are dealt to parts by
   hash, about ``GROUPS`` groups a part, so the number of parts follows the
   number of groups; a task takes its part's groups in blocks of bounded size,
   each block ending in one partial partition, and combines the blocks;
2. more than ``PARTS`` parts are combined in tasks of some ``PARTS`` each;
3. what is left, and the larger groups (fewer than shards x ``BIG``, whatever
   the data), each a partial partition of its own, are combined in one task: at
   most shards x (``PARTS`` + ``BIG``) rows of a few numbers, up to ``PARTS``
   squared parts.

A part's spread is at most about one small group, so the shards come out as
even as differencing everything at once would make them; a group larger than
a shard's even share makes its shard as large as the group.

Slots: a group's rows are counted per (text, salt of the id, or of the row's
place without one), so that a text that a third of all rows share is numbered
by many tasks; prefix sums of
those counts, of the groups in a part's bucket and of the parts in a shard
give every row a gapless slot in its shard.

Columns: ``doc_id`` and ``text``; others are ignored. Defined cases: a null
text counts no bytes, has a null checksum, and forms a group with rows of
the same id only; repeated rows are in one group and get slots of their own;
rows without an id come last in their group; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimart.llm.common import save, shuffle_partitions

SHARDS = 24         # contract
ROW_BYTES = 8       # contract: bytes counted beside the text
BLOCK = 20_000      # groups differenced at a time in a task
BIG = 1_024         # larger than the total / (SHARDS x BIG): combined at the end
GROUPS = 200_000    # groups a part
PARTS = 1_024       # parts combined in one task


def difference(nodes: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combine partial partitions (one list of sums each) by differencing.

    Returns the final sums and, for every node, the final place of each of
    its sums."""
    width = len(nodes[0])
    heap, tree = [], []
    for k, sums in enumerate(nodes):
        order = sorted(range(width), key=lambda i: -sums[i])
        ranked = [sums[i] for i in order]
        heap.append((ranked[-1] - ranked[0], k, ranked, order))
        tree.append(None)
    heapq.heapify(heap)
    # an entry's `order` maps its ranked place to a place of its tree node
    while len(heap) > 1:
        _, a, sums_a, order_a = heapq.heappop(heap)
        _, b, sums_b, order_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(sums_a, reversed(sums_b))]
        tree.append((a, order_a, b, order_b[::-1]))
        order = sorted(range(width), key=lambda i: -sums[i])
        ranked = [sums[i] for i in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(tree) - 1, ranked, order))
    _, root, sums, order = heap[0]
    place: dict[int, list[int]] = {root: _inverse(order)}
    out: list[list[int]] = [[] for _ in nodes]
    for k in range(root, -1, -1):
        own = place.pop(k, None)
        if own is None:
            continue
        if tree[k] is None:
            out[k] = own
            continue
        a, order_a, b, order_b = tree[k]
        for child, child_order in ((a, order_a), (b, order_b)):
            at = [0] * width
            for i, x in enumerate(child_order):
                at[x] = own[i]
            place[child] = at
    return sums, out


def _inverse(order: list[int]) -> list[int]:
    at = [0] * len(order)
    for i, x in enumerate(order):
        at[x] = i
    return at


def _part(df: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Bucket and row offset of every group of one part."""
    df = df.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
    size, n = df["bytes"].to_numpy(), df["n"].to_numpy()
    bucket = np.zeros(len(df), np.int64)
    blocks = []
    rest = [0] * (shards - 1)
    for at in range(0, len(df), BLOCK):
        sums, places = difference([[int(x), *rest] for x in size[at:at + BLOCK]])
        bucket[at:at + BLOCK] = [p[0] for p in places]
        blocks.append(sums)
    _, places = difference(blocks)
    for at, place in zip(range(0, len(df), BLOCK), places):
        bucket[at:at + BLOCK] = np.array(place)[bucket[at:at + BLOCK]]
    out = pd.DataFrame({"key": df["key"], "node": df["node"], "bucket": bucket.astype(np.int32),
                        "n": n, "bytes": size})
    out["ahead"] = out.groupby("bucket")["n"].cumsum() - out["n"]
    return out


def _whole(df: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Shard and slot offset of every bucket of every node."""
    df = df.sort_values(["node", "bucket"], ignore_index=True)
    at, _ = pd.factorize(df["node"])
    sums = np.zeros((at.max() + 1, shards), np.int64)
    sums[at, df["bucket"]] = df["bytes"]
    _, places = difference(sums.tolist())
    df["shard"] = np.array(places, np.int32)[at, df["bucket"]]
    df["base"] = df.groupby("shard")["n"].cumsum() - df["n"]
    return df[["node", "bucket", "shard", "base"]]


def _combined(nodes: DataFrame, shards: int) -> DataFrame:
    """``(over, node, bucket, shard, base)``: the nodes of each ``over``
    combined, from their sums ``(over, node, bucket, n, bytes)``."""
    def run(df: pd.DataFrame) -> pd.DataFrame:
        return _whole(df, shards).assign(over=df["over"].iloc[0])

    return (nodes.groupBy("over").applyInPandas(
        run, "node string, bucket int, shard int, base long, over string"))


def place(sums: DataFrame, shards: int, parts: int) -> DataFrame:
    """``(node, bucket, shard, base)`` from the nodes' sums ``(node, bucket, n,
    bytes)``: one level of differencing over ``PARTS`` parts or fewer, two over
    more."""
    top = F.lit("all").alias("over")
    if parts <= PARTS:
        return _combined(sums.select("*", top), shards).drop("over")
    of = F.concat(F.lit("parts:"), F.pmod(F.xxhash64("node"), F.lit(-(-parts // PARTS))).cast("string"))
    is_part = F.col("node").startswith("part:")
    middle = save(_combined(sums.where(is_part).withColumn("over", of), shards), "shard-middle")
    upper = (middle.join(sums, ["node", "bucket"])
                   .groupBy(F.col("over").alias("node"), F.col("shard").alias("bucket"))
                   .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    last = save(_combined(upper.unionByName(sums.where(~is_part)).select("*", top), shards)
                .drop("over"), "shard-last")
    above = last.select(F.col("node").alias("over"), F.col("bucket").alias("mid"),
                        F.col("shard").alias("end"), F.col("base").alias("ahead"))
    placed = (middle.withColumnRenamed("shard", "mid").join(above, ["over", "mid"])
                    .select("node", "bucket", F.col("end").alias("shard"),
                            (F.col("base") + F.col("ahead")).alias("base")))
    return placed.unionByName(last.where(~F.col("node").startswith("parts:")))


def shard(docs: DataFrame, shards: int = SHARDS, parts: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row. ``parts`` is the
    number of hash parts (default: as many as the session has shuffle
    partitions, more if a part would hold more than ``GROUPS`` groups)."""
    if shards < 1:
        raise ValueError(f"shards must be positive, got {shards}")
    salts = shuffle_partitions(docs.sparkSession)
    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    key = F.coalesce(F.md5(text), F.concat(F.lit("id:"), F.coalesce(doc.cast("string"), F.lit(""))))
    # saved: texts are read and hashed once
    rows = save(docs.select(
        doc.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), key.alias("key"),
        # a row without an id by its place (fixed once the table is saved), behind
        # the rows with one
        F.when(doc.isNull(), salts + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
         .otherwise(F.pmod(F.xxhash64(doc), F.lit(salts))).cast("int").alias("salt")), "shard-rows")
    salted = rows.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n"),
                                             F.sum("size").alias("bytes"))
    groups = save(salted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")),
                  "shard-groups")
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = parts or max(salts, -(-count // GROUPS))
    big = F.col("bytes") * (shards * BIG) > total
    node = F.concat(F.lit("part:"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("string"))
    small = groups.where(~big).withColumn("node", node).groupBy("node").applyInPandas(
        lambda df: _part(df, shards),
        "key string, node string, bucket int, n long, bytes long, ahead long")
    large = groups.where(big).select("key", F.col("key").alias("node"), F.lit(0).alias("bucket"),
                                     "n", "bytes", F.lit(0).cast("long").alias("ahead"))
    local = save(small.unionByName(large), "shard-buckets")
    placed = place(local.groupBy("node", "bucket").agg(F.sum("n").alias("n"),
                                                       F.sum("bytes").alias("bytes")), shards, parts)
    before = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    slots = (salted.select("key", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("own"))
                   .join(local.select("key", "node", "bucket", "ahead"), "key")
                   .join(placed, ["node", "bucket"])
                   .select("key", "salt", "shard",
                           (F.col("base") + F.col("ahead") + F.col("own")).alias("from")))
    number = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id")) - 1
    return (rows.withColumn("number", number).join(slots, ["key", "salt"])
                .select("doc_id", "size", "text_crc32", "shard",
                        (F.col("from") + F.col("number")).cast("long").alias("slot")))
