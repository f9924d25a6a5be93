"""Connected components of a link table, by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest node it
knows; small-star links the smaller side. Each round at least halves the
height of the trees, so a handful of rounds finish; every round is a table
in the shared checkpoint folder (lineage cut, nothing on the driver but two
counters). Only minima per node are aggregated (map-side combined), no
neighbour list is ever gathered. The links of a star's centre are spread
over salts, so no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimart.llm.common import save, shuffle_partitions


def with_least(rows: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """``rows`` with ``least``, the least ``value`` of their ``key``. The rows
    of a key are spread over as many salts as there are partitions (by the
    hash of ``by``); one row per key and salt meets with its like only."""
    salts = shuffle_partitions(rows.sparkSession)
    salted = rows.withColumn("_x_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    part = salted.groupBy(key, "_x_salt").agg(F.min(value).alias("_x_part"))
    least = part.select(key, "_x_salt", F.min("_x_part").over(Window.partitionBy(key)).alias("least"))
    return salted.join(least, [key, "_x_salt"]).drop("_x_salt")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over edges (a > b)."""
    both = edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    large = (with_least(both, "a", "b", "b").where(F.col("b") > F.col("a"))
             .select(F.col("b").alias("a"), F.least("a", "least").alias("b")))
    # every row of `large` already points to a smaller node
    small = (with_least(large, "a", "b", "b")
             .select(F.explode(F.array(
                 F.struct(F.col("a").alias("a"), F.col("least").alias("b")),
                 F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
             .select("e.a", "e.b"))
    return small.where(F.col("a") != F.col("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)`` (longs): the label
    is the smallest node reachable. Self links and nulls are ignored."""
    edges = (links.where(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .distinct())
    edges = save(edges, "cc")
    state = _state(edges)
    while state[0]:
        edges = save(_round(edges), "cc")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
                 .unionByName(roots.select("node", F.col("node").alias("label"))))
