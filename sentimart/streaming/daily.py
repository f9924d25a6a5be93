"""The daily job over a folder that keeps receiving new post files.

Structured Streaming reads new JSON files as they land. Each micro-batch is
cleaned, scored and classified once and reduced to the additive partial
table (per movie string, day and class: count, exact sums, min, max),
which is written under ``partials/batchId=<id>``. Writing a batch replaces
that batch's folder, so a retried batch leaves no duplicates; the
checkpoint records which files each batch read. The outputs are then
merged from all partial rows with the same plan as the batch job, so a
late post simply adds a row to its (movie, day) group.

``compact_partials`` keeps the number of folders small: it merges finished
batches into one table ``<partials>-merged/upTo=<id>``, which readers take in
place of the batches up to that one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentimart.plans.daily import DailyOutputs, movie_outputs, partial_aggregate, scored_posts
from sentimart.operators.match import unique_movies
from sentimart.schema import POST_SCHEMA, THRESHOLDS_DEFAULT
from sentimart.session import remove_dir


def stream_posts(spark: SparkSession, path: str, glob: str = "*.gz",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(POST_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)


def start_partials(spark: SparkSession, source: str, partials: str, checkpoint: str,
                   lexicon: DataFrame, modifiers: DataFrame, kind: str = "chicago",
                   thresholds: list[float] | None = None, available_now: bool = True,
                   processing_time: str | None = None,
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the stream that turns new files into partial rows."""
    thresholds = thresholds or THRESHOLDS_DEFAULT

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        classified = scored_posts(batch, lexicon, modifiers, kind, thresholds)
        part = partial_aggregate(classified, [])
        part.write.mode("overwrite").parquet(f"{partials.rstrip('/')}/batchId={batch_id}")

    w = (stream_posts(spark, source, max_files_per_trigger=max_files_per_trigger)
         .writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(
        processingTime=processing_time or "1 minute")
    return w.start()


def _numbered(spark: SparkSession, folder: str, key: str) -> list[int]:
    """Numbers of the folders ``<key>=<number>`` in ``folder``, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = (f.getPath().getName() for f in files.listStatus(path))
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{key}="))


def partial_rows(spark: SparkSession, partials: str) -> DataFrame:
    """Every batch's partial rows: the newest merged table and the batches after it."""
    partials = partials.rstrip("/")
    merged = _numbered(spark, f"{partials}-merged", "upTo")
    rows = spark.read.parquet(partials)
    if merged:
        rows = rows.where(F.col("batchId") > merged[-1])
    rows = rows.drop("batchId")
    if merged:
        rows = rows.unionByName(spark.read.parquet(f"{partials}-merged/upTo={merged[-1]}"))
    return rows


def _merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("movieName", "date", "vaderClassifier").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("sq").alias("sq"),
        F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def compact_partials(spark: SparkSession, partials: str, keep: int = 1) -> int | None:
    """Merge all batches but the last ``keep`` (at least 1: a restarted stream may
    write its last batch again). Returns the last merged batch, None if there is none.

    The merged table is staged and appears by one rename, so a lost driver
    leaves either the old state or the new one. What a merged table replaces
    is removed by the next call that merges, so a reader that started before
    this one keeps its files."""
    partials = partials.rstrip("/")
    merged_root = f"{partials}-merged"
    done = _numbered(spark, merged_root, "upTo")
    before = done[-1] if done else -1
    ready = _numbered(spark, partials, "batchId")[:-max(keep, 1)]
    ready = [i for i in ready if i > before]
    if not ready:
        return done[-1] if done else None
    last = ready[-1]
    rows = spark.read.parquet(partials).where(F.col("batchId").between(before + 1, last))
    rows = rows.drop("batchId")
    if done:
        rows = rows.unionByName(spark.read.parquet(f"{merged_root}/upTo={before}"))
    # sums keep the batches' types, however often they are merged
    out = _merge(rows).select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))
    staged = f"{merged_root}/_staged-{uuid.uuid4().hex[:12]}"
    out.write.parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(path(staged), path(f"{merged_root}/upTo={last}")):
        raise OSError(f"could not rename {staged}")
    for i in _numbered(spark, partials, "batchId"):
        if i <= before:
            remove_dir(spark, f"{partials}/batchId={i}")
    for i in done[:-1]:
        remove_dir(spark, f"{merged_root}/upTo={i}")
    return last


def outputs_from_partials(spark: SparkSession, partials: str, movies: DataFrame | None = None,
                          match: str = "like") -> DailyOutputs:
    """Counts and stats merged from every batch's partial rows."""
    merged = _merge(partial_rows(spark, partials))
    if movies is None:
        movies = unique_movies(merged.select("movieName").distinct())
    counts, stats, mapping = movie_outputs(merged, movies, [], match)
    return DailyOutputs(counts, stats, merged, mapping)
