"""Composed jobs: per-movie daily class counts and score statistics.

The original job loops over movies: filter, group, union -- the plan grows
with the number of movies and every branch re-reads and re-scores the
input. Here one plan serves all movies:

    posts -> clean -> score -> classify
          -> partial aggregate by (movie string, date, class)      [small]
          -> match movie strings to names (n-gram equi-join)      [tiny]
          -> join + final aggregate by (name, date[, class])

Scoring happens once per post. The partial aggregate keeps exact DECIMAL
sums of the 4-decimal scores and of their squares, so counts, means and
standard deviations of any movie (a union of movie strings) can be merged
from it without touching posts again. The partial table is what a hot
movie collapses into: map-side partial aggregation turns a movie holding a
third of all posts into at most one row per task and group.

With ``quantiles`` a partial row also holds the histogram of its scores. A
score has 4 decimals in [-1, 1], so a histogram has 20,001 bars at most however
many posts it stands for, adding two of them loses nothing, and the quantiles
of any movie and day are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentimart.operators.classify import check_splits, classify
from sentimart.operators.clean import FATE, clean_posts
from sentimart.operators.daily import exact_ratio
from sentimart.operators.match import match_names, movie_chunks, unique_movies
from sentimart.operators.score import score_text
from sentimart.schema import (COUNTS_COLUMNS, STATS_COLUMNS, STATS_DECIMALS,
                              THRESHOLDS_DEFAULT)
from sentimart.session import remove_dir, shared_dir

SCORE_DECIMAL = "decimal(10,4)"
QUARTILES = [0.25, 0.5, 0.75]


@dataclass
class DailyOutputs:
    counts: DataFrame
    stats: DataFrame
    partial: DataFrame
    mapping: DataFrame
    folder: str | None = None    # of the partial table, when it was written
    quantiles: DataFrame | None = None
    intake: DataFrame | None = None     # (fate, nRows) of the raw posts

    def close(self) -> None:
        """Drop the partial table (cached or written); the outputs cannot be
        computed any more afterwards."""
        self.partial.unpersist()
        if self.folder:
            remove_dir(self.partial.sparkSession, self.folder)
            self.folder = None


def materialize(partial: DataFrame, how: str | None) -> tuple[DataFrame, str | None]:
    """Keep the partial table for the several branches that read it; returns
    it and its folder, if it has one.

    ``table`` (default): write it as Parquet to a fresh folder under
    ``spark.checkpoint.dir`` and read it back -- one scoring job, lineage
    cut (a lost executor never forces re-scoring), and every later plan
    starts from a small scan. ``persist``: cache it (MEMORY_AND_DISK).
    ``None``: leave it lazy (each branch recomputes it).
    """
    if how == "table":
        spark = partial.sparkSession
        path = shared_dir(spark, "partial")
        partial.write.mode("overwrite").parquet(path)
        return spark.read.schema(partial.schema).parquet(path), path
    if how == "persist":
        return partial.persist(StorageLevel.MEMORY_AND_DISK), None
    if how is None:
        return partial, None
    raise ValueError(f"materialize must be 'table', 'persist' or None, got {how!r}")


def scored_posts(raw: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
                 kind: str = "chicago", thresholds: list[float] | None = None,
                 lang: str = "en", extra_keys: list[str] | None = None,
                 keep_arrays: bool = False, keep: list[str] | None = None,
                 min_partitions: int | None = None, mark: bool = False) -> DataFrame:
    """Clean, score and classify: one row per post with the movie string,
    the date, ``vaderScore`` and ``vaderClassifier`` (plus ``extra_keys`` of
    the raw posts and ``keep`` columns of the cleaned ones)."""
    extra_keys = list(extra_keys or [])
    posts = clean_posts(raw, kind=kind, lang=lang, keep_arrays=keep_arrays, extra=extra_keys,
                        mark=mark)
    if keep_arrays and kind == "gnip":
        # gnip folders name movies by the rule values, so exact matching
        # compares names with the value array
        posts = posts.withColumn("tags", F.col("values"))
    keep = ["movieName", "date", *extra_keys, *(keep or [])] + (["tags"] if keep_arrays else [])
    keep += [FATE] if mark else []
    scored = score_text(posts, lexicon, modifiers, text_col="body", keep=keep,
                        min_partitions=min_partitions)
    return classify(scored, thresholds=thresholds or THRESHOLDS_DEFAULT)


def partial_aggregate(classified: DataFrame, keys: list[str], histogram: bool = False) -> DataFrame:
    """Per (keys, movie string, date, class): count, exact sums, min, max, and
    with ``histogram`` the scores, ``hist`` of (v in 10,000ths, n)."""
    d = F.col("vaderScore").cast(SCORE_DECIMAL)
    if histogram:
        by = [*keys, "movieName", "date", "vaderClassifier"]
        bars = classified.groupBy(*by, "vaderScore").agg(F.count("vaderScore").alias("n"))
        n = F.col("n").cast("decimal(20,0)")
        bar = F.struct((d * 10_000).cast("int").alias("v"), "n")
        return bars.groupBy(*by).agg(
            F.sum("n").alias("n"),
            F.sum(d * n).cast("decimal(20,4)").alias("s"),
            F.sum((d * d).cast("decimal(17,8)") * n).cast("decimal(31,8)").alias("sq"),
            F.min("vaderScore").alias("mn"),
            F.max("vaderScore").alias("mx"),
            F.sort_array(F.collect_list(F.when(F.col("n") > 0, bar))).alias("hist"),
        )
    return classified.groupBy(*keys, "movieName", "date", "vaderClassifier").agg(
        F.count(F.col("vaderScore")).alias("n"),
        F.sum(d).alias("s"),
        F.sum(d * d).alias("sq"),
        F.min("vaderScore").alias("mn"),
        F.max("vaderScore").alias("mx"),
    )


def _stats_from_partial(grouped, keys: list[str], extra: dict | None = None) -> DataFrame:
    """Merge partial rows into the statistics; ``extra`` adds further
    aggregates (name -> expression) computed in the same pass."""
    n = F.sum("n")
    extra = dict(extra or {})
    agg = grouped.agg(n.alias("_n"), F.sum("s").alias("_sdec"), F.sum("sq").cast("double").alias("_sq"),
                      F.min("mn").alias("minScore"), F.max("mx").alias("maxScore"),
                      *[e.alias(k) for k, e in extra.items()])
    agg = agg.withColumn("_s", F.col("_sdec").cast("double"))
    cnt = F.col("_n").cast("double")
    var = (F.col("_sq") - F.col("_s") * F.col("_s") / cnt) / (cnt - 1)
    return agg.select(
        *keys, "date",
        exact_ratio(F.col("_sdec"), F.col("_n").cast("decimal(20,0)")).alias("avgScore"),
        F.when(F.col("_n") > 1,
               F.round(F.sqrt(F.greatest(var, F.lit(0.0))), STATS_DECIMALS)).alias("stdDev"),
        "minScore", "maxScore",
        F.col("_n").alias("totalTweets"),
        F.col("name").alias("movieName"),
        *extra.keys(),
    )


def quantile_columns(probabilities: list[float]) -> list[str]:
    """``p25Score`` .. of the probabilities; a half is ``medianScore``."""
    return ["medianScore" if p == 0.5 else f"p{100 * p:g}Score".replace(".", "_")
            for p in probabilities]


def movie_quantiles(partial: DataFrame, mapping: DataFrame, probabilities: list[float] = QUARTILES,
                    on: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """A11 per movie: score quantiles per (keys, movie, day) from the
    histograms of the partial rows (interpolated like SQL ``percentile_cont``,
    rounded). ``on`` names further join keys of partial and mapping. No text is
    read or scored again."""
    bars = (partial.select(*partial.drop("hist").columns, F.inline("hist").alias("_v", "_count")))
    joined = bars.join(mapping, [*(on or []), "movieName"])
    merged = joined.groupBy(*(keys or []), "name", "date", "_v").agg(F.sum("_count").alias("_count"))
    q = F.percentile(F.col("_v"), F.array(*map(F.lit, probabilities)), F.col("_count"))
    out = merged.groupBy(*(keys or []), "name", "date").agg(
        q.alias("_q"), F.sum("_count").alias("totalTweets"))
    cols = [F.round(F.col("_q")[i] / 10_000, STATS_DECIMALS).alias(c)
            for i, c in enumerate(quantile_columns(probabilities))]
    return out.select(*(keys or []), "date", *cols, "totalTweets", F.col("name").alias("movieName"))


def movie_summary(partial: DataFrame, names: DataFrame, n_classes: int,
                  match: str = "like") -> DataFrame:
    """Statistics and one count column per class (``nClass0`` ..) per movie
    and day, in one aggregate over the joined partial rows."""
    tags = "tags" if match == "exact" else None
    strings = partial.select("movieName", *([tags] if tags else [])).distinct()
    mapping = match_names(strings, names.select("movieName"), match=match, tags_col=tags)
    part = partial.drop("tags", "hist")
    joined = part.join(mapping, "movieName")
    per_class = {f"nClass{k}": F.sum(F.when(F.col("vaderClassifier") == float(k), F.col("n"))
                                      .otherwise(F.lit(0)))
                 for k in range(n_classes)}
    return _stats_from_partial(joined.groupBy("name", "date"), [], per_class)


def movie_outputs(partial: DataFrame, names: DataFrame, keys: list[str] | None = None,
                  match: str = "like", order: bool = True,
                  name_extra: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts and stats for every movie in ``names``.

    ``names`` has ``movieName`` (+ ``keys`` when movies are per key, e.g.
    per folder; a list without them holds for every key; + ``name_extra``
    columns carried to the outputs, e.g. ``chunkId``). Returns (counts, stats, mapping).
    """
    keys = list(keys or [])
    name_extra = list(name_extra or [])
    tags = "tags" if match == "exact" else None
    # a plain list of names (no key columns) holds for every key
    per_key = bool(keys) and set(keys) <= set(names.columns)
    match_on = keys if per_key else []
    str_cols = [*match_on, "movieName"] + ([tags] if tags else [])
    strings = partial.select(*str_cols).distinct()
    if per_key:
        mapping = _match_by_keys(strings, names, keys, match, tags, name_extra)
    else:
        mapping = match_names(strings, names.select("movieName"), match=match, tags_col=tags)
        if name_extra:
            mapping = mapping.join(names.select(F.col("movieName").alias("name"), *name_extra),
                                   "name")
    part = partial.drop("tags", "hist")
    joined = part.join(mapping, [*match_on, "movieName"])
    out_keys = [*keys, *name_extra]
    counts = (joined.groupBy(*out_keys, "name", "date", "vaderClassifier")
                    .agg(F.sum("n").alias("nTweets"))
                    .select(*out_keys, *[c if c != "movieName" else F.col("name").alias("movieName")
                                         for c in COUNTS_COLUMNS]))
    stats = _stats_from_partial(joined.groupBy(*out_keys, "name", "date"), out_keys)
    stats = stats.select(*out_keys, *STATS_COLUMNS)
    if order:
        counts = counts.orderBy(*out_keys, "movieName", F.desc("date"), F.desc("vaderClassifier"))
        stats = stats.orderBy(*out_keys, "movieName", F.desc("date"))
    return counts, stats, mapping


def _match_by_keys(strings: DataFrame, names: DataFrame, keys: list[str], match: str,
                   tags: str | None, name_extra: list[str]) -> DataFrame:
    """Per-key matching (e.g. movies found per folder): match the distinct
    strings against the distinct names once, then keep the pairs whose
    string and name share the key (equi-join on the keys)."""
    str_cols = ["movieName"] + ([tags] if tags else [])
    pairs = match_names(strings.select(*str_cols).distinct(),
                        names.select("movieName").distinct(), match=match, tags_col=tags)
    return (strings.select(*keys, "movieName").distinct()
                   .join(pairs, "movieName")
                   .join(names.select(*keys, F.col("movieName").alias("name"), *name_extra),
                         [*keys, "name"])
                   .select(*keys, "movieName", "name", *name_extra)
                   .distinct())


def daily_sentiment(raw: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
                    kind: str = "chicago", thresholds: list[float] | None = None,
                    movies: DataFrame | None = None, match: str = "like",
                    keys: list[str] | None = None, name_extra: list[str] | None = None,
                    lang: str = "en", persist: bool | str | None = True,
                    order: bool = True, min_partitions: int | None = None,
                    quantiles: list[float] | None = None, intake: bool = False) -> DailyOutputs:
    """C4/C5 (flagship): load, score, classify, movies found or given, both outputs
    and, with ``quantiles`` (probabilities), the quantiles per movie and day.

    ``intake`` also counts the raw posts by what became of them (malformed,
    other language, nulls, kept). The counts are rows of the partial table, so
    they come from the same scan, and a task that runs again can't double them
    as it could an accumulator. Read the posts with ``read_marked`` to have the
    malformed lines counted.

    ``movies`` (``movieName`` [+ keys] [+ name_extra]) -- when omitted, the
    movies are the single-movie strings found in the data (per ``keys``).
    ``persist`` keeps the small partial table (one row per movie string,
    day and class) for every branch that reads it: the outputs, the movie
    discovery and the match (``True`` or ``"table"``: written to the shared
    checkpoint folder; ``"persist"``: cached; ``False``: lazy). Without it,
    column pruning makes the branches differ, exchanges are not reused and
    posts are scored once per branch.
    """
    thresholds = check_splits(thresholds or THRESHOLDS_DEFAULT)
    keys = list(keys or [])
    classified = scored_posts(raw, lexicon, modifiers, kind, thresholds, lang,
                              extra_keys=keys, keep_arrays=(match == "exact"),
                              min_partitions=min_partitions, mark=intake)
    by = keys + (["tags"] if match == "exact" else []) + ([FATE] if intake else [])
    partial = partial_aggregate(classified, by, histogram=bool(quantiles))
    how = "table" if persist is True else (persist or None)
    partial, folder = materialize(partial, how)
    fates = None
    if intake:
        fates = partial.groupBy(F.col(FATE).alias("fate")).agg(F.sum("n").alias("nRows"))
        partial = partial.where(F.col(FATE) == "kept").drop(FATE)
    if movies is None:
        found = partial.select(*keys, "movieName").distinct()
        if keys:
            movies = _unique_by_keys(found, keys)
        else:
            movies = unique_movies(found)
    counts, stats, mapping = movie_outputs(partial, movies, keys, match, order, name_extra)
    found = None
    if quantiles:
        # the mapping has the keys when movies are per key
        on = [k for k in keys if k in mapping.columns]
        found = movie_quantiles(partial, mapping, quantiles, on, [*keys, *(name_extra or [])])
    return DailyOutputs(counts, stats, partial, mapping, folder, found, fates)


def _unique_by_keys(found: DataFrame, keys: list[str]) -> DataFrame:
    m = F.col("movieName")
    return (found.where(~m.like("%,%"))
                 .select(*keys, F.substring(m, F.lit(2), F.length(m) - F.lit(2)).alias("movieName"))
                 .where(F.length("movieName") > 0)
                 .distinct())


def daily_summary(raw: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
                  kind: str = "chicago", thresholds: list[float] | None = None,
                  movies: DataFrame | None = None, match: str = "like",
                  min_partitions: int | None = None) -> DataFrame:
    """Both outputs in one table per (movie, day): statistics plus one count
    column per class (``nClass0`` ..), from a single aggregate. The partial
    table it reads belongs to the caller's ``workspace``."""
    thresholds = check_splits(thresholds or THRESHOLDS_DEFAULT)
    classified = scored_posts(raw, lexicon, modifiers, kind, thresholds,
                              keep_arrays=(match == "exact"), min_partitions=min_partitions)
    partial = partial_aggregate(classified, ["tags"] if match == "exact" else [])
    partial, _ = materialize(partial, "table")
    if movies is None:
        movies = unique_movies(partial.select("movieName").distinct())
    return movie_summary(partial, movies, len(thresholds) - 1, match)


def chunked_daily(raw: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
                  movie_list: DataFrame | None = None, kind: str = "gnip",
                  thresholds: list[float] | None = None, match: str = "like",
                  min_partitions: int | None = None) -> DailyOutputs:
    """Outputs for a chunked movie list in ONE job; ``chunkId`` carried
    to the outputs (the original reloads and rescores the data per chunk).
    Without a list, movies are found and chunked first (C6-C8)."""
    thresholds = check_splits(thresholds or THRESHOLDS_DEFAULT)
    classified = scored_posts(raw, lexicon, modifiers, kind, thresholds,
                              min_partitions=min_partitions)
    partial, folder = materialize(partial_aggregate(classified, []), "table")
    if movie_list is None:
        movie_list = movie_chunks(unique_movies(partial.select("movieName").distinct()))
    counts, stats, mapping = movie_outputs(partial, movie_list, [], match,
                                           name_extra=["chunkId"])
    return DailyOutputs(counts, stats, partial, mapping, folder)


def _regroup(partial: DataFrame, movie_col: str, keys: list[str]) -> DataFrame:
    """Partial rows of a wider table, merged to the keys and movie column."""
    return (partial.withColumn("movieName", F.col(movie_col))
                   .groupBy(*keys, "movieName", "date", "vaderClassifier")
                   .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq"),
                        F.min("mn").alias("mn"), F.max("mx").alias("mx")))


def both_kinds(raw: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
               thresholds: list[float] | None = None, match: str = "like",
               keys: list[str] | None = None,
               min_partitions: int | None = None) -> tuple[DailyOutputs, DailyOutputs]:
    """The outputs by rule tag (chicago kind) and by rule value (gnip kind),
    from ONE scoring pass: the partial table carries both strings and the
    ``keys`` (e.g. ``folder``). The chicago side is per ``keys``, the gnip
    side is chunked (``chunkId``). Both share one folder; close the first."""
    if match == "exact":
        raise ValueError("both_kinds matches by 'like' or 'contains'")
    thresholds = check_splits(thresholds or THRESHOLDS_DEFAULT)
    keys = list(keys or [])
    classified = scored_posts(raw, lexicon, modifiers, "chicago", thresholds, extra_keys=keys,
                              keep=["searchPattern"], min_partitions=min_partitions)
    wide, folder = materialize(partial_aggregate(classified, [*keys, "searchPattern"]), "table")
    by_tag = _regroup(wide, "movieName", keys)
    found = by_tag.select(*keys, "movieName").distinct()
    movies = _unique_by_keys(found, keys) if keys else unique_movies(found)
    chicago = DailyOutputs(*movie_outputs(by_tag, movies, keys, match, False)[:2], by_tag, movies,
                           folder)
    by_value = _regroup(wide, "searchPattern", [])
    listed = movie_chunks(unique_movies(by_value.select("movieName").distinct()))
    gnip = DailyOutputs(*movie_outputs(by_value, listed, [], match, False, ["chunkId"])[:2],
                        by_value, listed)
    return chicago, gnip
