"""Daily aggregates over scored posts.

Every aggregate is a hash aggregate with a partial (map-side) step, so a
hot day or movie is reduced inside each task before the shuffle.
Statistics are rounded to ``STATS_DECIMALS`` so results are stable across
engines and runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimart.schema import STATS_DECIMALS

SCORE_COLUMNS = ["neg", "neu", "pos", "comp"]


def _r(c):
    return F.round(c, STATS_DECIMALS)


def exact_avg(c, scale: int = 4):
    """Mean of values with at most ``scale`` decimals, computed exactly.

    The sum is a DECIMAL (exact, independent of the order partial sums
    arrive in) and the quotient is rounded half-up to ``STATS_DECIMALS``.
    A double mean can land on either side of a rounding tie (16 scores
    with 4 decimals have a mean with 8), so the last digit would depend
    on the shuffle order.
    """
    total = F.sum(F.col(c).cast(f"decimal(20,{scale})") if isinstance(c, str)
                  else c.cast(f"decimal(20,{scale})"))
    n = F.count(c).cast("decimal(20,0)")
    return exact_ratio(total, n)


def exact_ratio(total, n):
    """Rounded half-up ``total / n`` (both DECIMAL), as a double."""
    return F.round(total / n, STATS_DECIMALS).cast("double")


def daily_counts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """A1: posts per day -> ``(dateColumn, totalTweets)``."""
    return (df.groupBy(F.col(date_col).alias("dateColumn"))
              .agg(F.count(F.lit(1)).alias("totalTweets")))


def counts_by_class(df: DataFrame, class_col: str = "vaderClassifier",
                    keys: list[str] | None = None) -> DataFrame:
    """A2 + O2: posts per day and class, newest first."""
    keys = keys or []
    out = (df.groupBy(*keys, "date", class_col)
             .agg(F.count(F.lit(1)).alias("nTweets")))
    return out.orderBy(*keys, F.desc("date"), F.desc(class_col))


def daily_stats(df: DataFrame, score_col: str = "vaderScore",
                keys: list[str] | None = None) -> DataFrame:
    """A3 + O1: mean, sample standard deviation, min, max, count per day.

    ``count`` skips NULL scores like the original ``count(col)``. One post
    in a day gives a NULL standard deviation.
    """
    keys = keys or []
    s = F.col(score_col)
    out = df.groupBy(*keys, "date").agg(
        exact_avg(s).alias("avgScore"),
        _r(F.stddev_samp(s)).alias("stdDev"),
        F.min(s).alias("minScore"),
        F.max(s).alias("maxScore"),
        F.count(s).alias("totalTweets"),
    )
    return out.orderBy(*keys, F.desc("date"))


def describe_daily_counts(df: DataFrame, date_col: str = "date") -> DataFrame:
    """A4: count, mean, stddev, min, max of the posts-per-day column."""
    c = F.col("totalTweets")
    return daily_counts(df, date_col).agg(
        F.count(c).alias("nDays"),
        exact_avg(c, 0).alias("meanTweets"),
        _r(F.stddev_samp(c)).alias("stdTweets"),
        F.min(c).alias("minTweets"),
        F.max(c).alias("maxTweets"),
    )


def describe_scores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A5: one row per score column with count, mean, stddev, min, max.

    One global aggregate (partial per task, one final row), then the row is
    turned into one row per column.
    """
    columns = columns or SCORE_COLUMNS
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__count"), exact_avg(c).alias(f"{c}__mean"),
                 _r(F.stddev_samp(c)).alias(f"{c}__stddev"),
                 F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"),
                              F.col(f"{c}__count").alias("count"),
                              F.col(f"{c}__mean").alias("mean"),
                              F.col(f"{c}__stddev").alias("stddev"),
                              F.col(f"{c}__min").alias("min"),
                              F.col(f"{c}__max").alias("max")) for c in columns])
    return wide.select(F.inline(rows))


def row_counts(raw: DataFrame, subset: list[str]) -> DataFrame:
    """Rows, and rows with none of ``subset`` null, in one pass."""
    all_present = F.lit(True)
    for c in subset:
        present = F.col(c).isNotNull()
        if dict(raw.dtypes).get(c) in ("double", "float"):
            present = present & ~F.isnan(F.col(c))
        all_present = all_present & present
    return raw.agg(F.count(F.lit(1)).alias("nRows"),
                   F.count(F.when(all_present, True)).alias("nRowsNoNulls"))


def describe_frame(df: DataFrame) -> DataFrame:
    """A10: one typed row per numeric or string column: ``column, count,
    mean, stddev, min, max``. Mean and deviation are null for strings; min and
    max are strings, of numbers by value. One global aggregate."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = [(c, t) for c, t in df.dtypes
             if t in numeric or t.startswith("decimal") or t == "string"]
    aggs = []
    for i, (c, t) in enumerate(kinds):
        x = F.col(f"`{c}`")
        number = x.cast("double") if t != "string" else F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), _r(F.avg(number)).alias(f"a{i}"),
                 _r(F.stddev_samp(number)).alias(f"s{i}"),
                 F.min(x).cast("string").alias(f"l{i}"), F.max(x).cast("string").alias(f"h{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                              F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("stddev"),
                              F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"))
                     for i, (c, _) in enumerate(kinds)])
    return df.agg(*aggs).select(F.inline(rows))


def daily_percentiles(df: DataFrame, score_col: str = "vaderScore",
                      keys: list[str] | None = None,
                      exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """25th, 50th and 75th percentile per day.

    The exact version interpolates like SQL ``percentile_cont``; its buffer
    holds one entry per distinct value, and scores have 4 decimals, so a
    group never holds more than 20,001 entries however many posts it has.
    ``exact=False`` uses ``percentile_approx`` (bounded sketch).
    """
    keys = keys or []
    s = F.col(score_col)
    if exact:
        p = F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    else:
        p = F.percentile_approx(s, [0.25, 0.5, 0.75], accuracy).cast("array<double>")
    out = df.groupBy(*keys, "date").agg(p.alias("_p"))
    return out.select(*keys, "date",
                      _r(F.col("_p")[0]).alias("p25Score"),
                      _r(F.col("_p")[1]).alias("medianScore"),
                      _r(F.col("_p")[2]).alias("p75Score"))


def counts_wide(df: DataFrame, n_classes: int, class_col: str = "vaderClassifier",
                keys: list[str] | None = None) -> DataFrame:
    """Class counts per day as columns ``nClass0`` .. (values listed,
    so no extra job to discover them)."""
    keys = keys or []
    aggs = [F.count(F.when(F.col(class_col) == float(k), True)).alias(f"nClass{k}")
            for k in range(n_classes)]
    return df.groupBy(*keys, "date").agg(*aggs, F.count(F.lit(1)).alias("totalTweets"))


def top_days(stats: DataFrame, n: int = 10, by: str = "totalTweets") -> DataFrame:
    """O3: the ``n`` busiest days (a top-k report; TakeOrderedAndProject)."""
    return stats.orderBy(F.desc(by), F.desc("date")).limit(n)


def output_movies(out: DataFrame) -> DataFrame:
    """Movie names present in an output table."""
    return out.select("movieName").distinct()
