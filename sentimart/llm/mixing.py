"""Mixing sources to target weights (operator 4), built-in functions only.

Targets: the sources, in code point order with null last, weigh 5, 2, 1,
repeating, and share ``share`` times all words. No target passes ``most``
times its source's size; what is cut off is shared anew by weight. That is
one water level: with the sources sorted by cap / weight, prefix sums give
the level, and a target is the smaller of its cap and level * weight.

Selection: every document gets a hash-random key. The keys of a source are
cut into equal ranges (uniform, so the ranges are even; a source that holds
a third of all rows has as many ranges as any other and no range is large),
sorted inside each range, and word counts are summed along: a running sum in
the range plus the sum of the ranges before it, one small row per source and
range. A document's place against its source's budget decides: whole passes
first, then the documents before the cut once more; the one on the cut gives
its first words so that the source meets its target to the word.

Columns: ``doc_id``, ``text``, ``source``; others are ignored (``mix``) or
kept (``mixed_rows``). Defined cases: null text counts no words; null
sources are one source, the last; equal keys (repeated rows) are one place
and share it by a running count, so reruns agree up to identical rows;
sources without words take none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentimart.llm.common import ROW, count_words, save, shuffle_partitions

WEIGHTS = (5.0, 2.0, 1.0)   # contract, repeating
SHARE = 1.5                 # contract: words mixed, as a part of all words
MOST = 2.0                  # contract: a target's bound, times its source's size
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``,
    one row per source.

    The windows below run over that table, one row per source, not over
    documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.row_number().over(by_name) - 1) % len(weights) + 1)
    t = sizes.select("source", "source_size", w.alias("w"))
    t = t.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*", (F.sum("source_size").over(every) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    # the level if this source and all after it stay below their caps
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("level", F.max(fits).over(every))
    return t.select("source", "source_size",
                    F.when(F.col("level").isNull(), F.col("cap"))
                     .otherwise(F.least("cap", F.col("level") * F.col("w"))).alias("target"))


def mix(docs: DataFrame, ranges: int | None = None, seed: str = SEED, weights: tuple = WEIGHTS,
        share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    taken, copies, _x_key``. ``taken`` counts words, repeats included;
    ``copies`` is the number of passes that touch the document. ``ranges``
    per source (default: the session's shuffle partitions) only spreads the
    work; the result is the same for any number."""
    ranges = ranges or shuffle_partitions(docs.sparkSession)
    text = F.col("text").cast("string")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                         F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    # saved: texts are read and hashed once, the rest moves a few numbers
    rows = save(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.col("source").cast("string").alias("source"),
                            count_words(text).alias("size"), key.alias("key")), "mix")
    part = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.lit(ranges)
                   / F.lit(16 ** 7)).cast("int")
    rows = rows.select("*", part.alias("part"))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    offsets = parts.select(
        "source", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"),
        F.sum("words").over(whole).alias("source_size"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                   weights, share, most)
    plan = save(offsets.alias("o").join(goal.alias("g"),
                                        F.col("o.source").eqNullSafe(F.col("g.source")))
                .select(F.col("o.source").alias("p_source"), F.col("o.part").alias("p_part"),
                        "o.ahead", "o.source_size", "g.target"), "mix-plan")
    run = (Window.partitionBy("source", "part").orderBy("key")
           .rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(run), F.lit(0)))
    r = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source"))
                    & (F.col("part") == F.col("p_part")))
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0,
                    F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(F.lit(0))
    r = r.select("*", budget.alias("budget"), passes.cast("long").alias("passes"),
                 (F.col("ahead") + F.col("inside")).alias("before"))
    rest = F.col("budget") - F.col("passes") * F.col("source_size")
    once = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return r.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + once).alias("taken"),
        (F.col("passes") + F.when(F.col("before") < rest, 1).otherwise(0)).cast("int")
        .alias("copies"), F.col("key").alias("_x_key"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as passes touch it, all
    columns as they were. The document on a source's cut comes whole, so a
    source passes its target by less than one document."""
    seed = options.get("seed", SEED)

    def with_source(key):
        source = F.col("source").cast("string")
        return F.concat(key, F.coalesce(F.concat(F.lit(":"), source), F.lit(""))).alias("_x_key")

    copies = save(mix(docs, **options).groupBy(with_source(F.col("_x_key")))
                  .agg(F.sum("copies").alias("_x_all"), F.count(F.lit(1)).alias("_x_n"))
                  .where(F.col("_x_all") > 0)
                  .select("_x_key", F.floor(F.col("_x_all") / F.col("_x_n")).cast("int")
                          .alias("_x_each"), (F.col("_x_all") % F.col("_x_n")).alias("_x_more")),
                  "copies")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                         F.lit(":"), F.md5(text)))
    rows = docs.select(F.struct("*").alias(ROW), with_source(key))
    even = (rows.join(copies.where(F.col("_x_more") == 0), "_x_key")
                .select(ROW, F.col("_x_each").alias("_x_copies")))
    # the cut falls among repeated rows: the first of them carry one more,
    # numbered inside the part that each task saved. Saved on their own, as
    # there are at most as many such keys as sources, so texts do not move
    uneven = save(copies.where(F.col("_x_more") > 0), "uneven")
    odd = save(rows.join(uneven, "_x_key")
                   .withColumn("_x_row_id", F.monotonically_increasing_id())
                   .withColumn("_x_salt", F.shiftright("_x_row_id", 33)), "mix-odd")
    salts = odd.groupBy("_x_key", "_x_salt").agg(F.count(F.lit(1)).alias("_x_rows"))
    ahead = (Window.partitionBy("_x_key").orderBy("_x_salt")
             .rowsBetween(Window.unboundedPreceding, -1))
    salts = salts.select("_x_key", "_x_salt",
                         F.coalesce(F.sum("_x_rows").over(ahead), F.lit(0)).alias("_x_ahead"))
    inside = Window.partitionBy("_x_key", "_x_salt").orderBy("_x_row_id")
    number = F.col("_x_ahead") + F.col("_x_inside")
    odd = (odd.withColumn("_x_inside", F.row_number().over(inside))
              .join(salts, ["_x_key", "_x_salt"])
              .select(ROW, (F.col("_x_each") + F.when(number <= F.col("_x_more"), 1).otherwise(0))
                      .alias("_x_copies")))
    return (even.unionByName(odd).where(F.col("_x_copies") > 0)
                .select(ROW, F.explode(F.sequence(F.lit(1), F.col("_x_copies"))))
                .select(f"{ROW}.*"))
