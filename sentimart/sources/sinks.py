"""Writers (S7-S9) and the staging of derived posts as JSON files.

Outputs are written by the executors (no ``toPandas`` on the driver). Several
runs share an output folder: with ``partition_by`` only the partitions that a
run writes are replaced, and ``write_named_csv`` replaces one file per key, so
a run of another folder or chunk is left alone and a repeated run changes
nothing. CSV values come back as they were written: no trimming, quotes
doubled, line breaks inside quotes, an empty string apart from a null.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentimart.schema import COUNTS_SCHEMA, MOVIE_LIST_SCHEMA, STATS_SCHEMA
from sentimart.session import remove_dir


_KINDS = {"string": T.StringType, "int": T.IntegerType, "long": T.LongType}

# the same for writing and reading; the line separator is given so that line
# breaks inside quotes are left as they are
CSV_OPTIONS = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
               "nullValue": "", "emptyValue": '""', "lineSep": "\n"}


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None,
              single_file: bool = False, mode: str = "overwrite") -> None:
    """CSV with header, UTF-8. ``partition_by`` gives the
    ``<out>/<kind>/daily/folder=<f>/`` layout and replaces only the partitions
    that have rows here; without it the whole folder is replaced."""
    if single_file:
        df = df.repartition(*partition_by) if partition_by else df.coalesce(1)
    w = df.write.mode(mode).options(**CSV_OPTIONS)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.csv(path)


def read_csv(spark: SparkSession, path: str, schema,
             partition_by: list[tuple[str, str]] | None = None) -> DataFrame:
    """``partition_by``: name and type of the columns in the folder names."""
    for name, kind in partition_by or ():
        schema = T.StructType([*schema.fields, T.StructField(name, _KINDS[kind]())])
    # an unquoted empty field is read as the null mark, which no value can be
    options = {**CSV_OPTIONS, "multiLine": "true", "emptyValue": "", "nullValue": "\0null"}
    return spark.read.options(**options).schema(schema).csv(path)


def _fs(spark: SparkSession, path: str):
    """Hadoop path and its file system: whatever the readers and writers use."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, source, target, files) -> None:
    """Rename a file over another, in one step where the file system can."""
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            target.toUri(), spark._jsc.hadoopConfiguration())
    except Py4JJavaError as e:   # not every scheme has a file context
        if "UnsupportedFileSystem" not in str(e.java_exception):
            raise
        files.delete(target, False)
        if not files.rename(source, target):
            raise OSError(f"could not rename {source} to {target}") from None
        return
    context.rename(source, target, how)


def write_named_csv(df: DataFrame, out: str, name: str | Column, order: list[str] | None = None,
                    names: list[str] | None = None) -> list[str]:
    """One file ``<out>/<name>.csv`` for every value of ``name``; returns
    the names.

    The executors write to a staging folder inside ``out``, every name in one
    task (rows sorted by ``order``); then each file is renamed over the former
    one. The driver renames files, it sees no rows. Other names' files stay;
    a failed run leaves the former files as they were, a repeated run replaces
    them. ``names`` lists names that must have a file even without rows (a
    header alone). A slash in a name is written ``%2F``, a null name ``null``."""
    spark = df.sparkSession
    column = F.col(name) if isinstance(name, str) else name
    stage = f"{out.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    kept = [c for c in df.columns if c != name]
    rows = (df.withColumn("_file", F.coalesce(column.cast("string"), F.lit("null")))
              .select("_file", *[F.col(f"`{c}`") for c in kept]))
    place, files = _fs(spark, stage)
    base = _fs(spark, out)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        (rows.repartition("_file").sortWithinPartitions("_file", *(order or []))
             .write.partitionBy("_file").options(**CSV_OPTIONS)
             .option("maxRecordsPerFile", 0).csv(stage))
        written = []
        for folder in files.listStatus(place):
            key = folder.getPath().getName()
            if not key.startswith("_file="):
                continue
            parts = [f.getPath() for f in files.listStatus(folder.getPath())
                     if f.getPath().getName().startswith("part-")]
            if len(parts) != 1:
                raise RuntimeError(f"{len(parts)} files for {key}")
            key = unquote(key.removeprefix("_file="))
            _put(spark, parts[0], path(base, f"{key.replace('/', '%2F')}.csv"), files)
            written.append(key)
        for key in sorted(set(names or ()) - set(written)):
            line = io.StringIO()
            csv.writer(line, lineterminator="\n").writerow(kept)
            empty = path(place, uuid.uuid4().hex)
            stream = files.create(empty)
            stream.write(bytearray(line.getvalue().encode()))
            stream.close()
            _put(spark, empty, path(base, f"{key.replace('/', '%2F')}.csv"), files)
            written.append(key)
    finally:
        remove_dir(spark, stage)
    return sorted(written)


def read_named_csv(spark: SparkSession, out: str, schema: T.StructType, name: str) -> DataFrame:
    """The files of ``write_named_csv``, with their names in column ``name``."""
    df = read_csv(spark, f"{out.rstrip('/')}/*.csv", schema)
    file = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"),
                                                   F.lit("%2B"))), r"\.csv$", "")
    return df.withColumn(name, F.replace(file, F.lit("%2F"), F.lit("/")))


def read_counts(spark: SparkSession, path: str,
                partition_by: list[tuple[str, str]] | None = None) -> DataFrame:
    return read_csv(spark, path, COUNTS_SCHEMA, partition_by)


def read_stats(spark: SparkSession, path: str,
               partition_by: list[tuple[str, str]] | None = None) -> DataFrame:
    return read_csv(spark, path, STATS_SCHEMA, partition_by)


def write_daily(counts: DataFrame, stats: DataFrame, out_root: str,
                partition_by: list[str] | None = None, single_file: bool = False,
                below: str | None = None) -> None:
    """Both outputs: ``<out_root>/counts/daily`` and ``<out_root>/stats/daily``;
    ``below`` writes to one partition folder there, replaced as a whole."""
    for df, kind in ((counts, "counts"), (stats, "stats")):
        path = f"{out_root}/{kind}/daily" + (f"/{below}" if below else "")
        write_csv(df, path, partition_by, single_file)


def write_daily_files(counts: DataFrame, stats: DataFrame, out_root: str, name: str | Column,
                      names: list[str] | None = None) -> None:
    """Both outputs as one file per name: ``<out_root>/counts/daily/<name>.csv``
    and ``<out_root>/stats/daily/<name>.csv``."""
    write_named_csv(counts, f"{out_root}/counts/daily", name,
                    ["movieName", "date", "vaderClassifier"], names)
    write_named_csv(stats, f"{out_root}/stats/daily", name, ["movieName", "date"], names)


def save_movie_list(movies: DataFrame, path: str, name: str | None = None) -> None:
    """The movie list table ``(movieName, chunkId)`` as Parquet,
    partitioned by chunk so one chunk can be read alone. ``name``: lists of
    several inputs in one folder, ``<path>/list=<name>``; a list is replaced as
    a whole, so no chunk of a longer former list is left."""
    target = path if name is None else f"{path.rstrip('/')}/list={name}"
    (movies.select("movieName", "chunkId").write.mode("overwrite")
           .option("partitionOverwriteMode", "static").partitionBy("chunkId").parquet(target))


def load_movie_list(spark: SparkSession, path: str, chunk: int | None = None,
                    name: str | None = None) -> DataFrame:
    if name is not None:
        path = f"{path.rstrip('/')}/list={name}"
    df = spark.read.schema(MOVIE_LIST_SCHEMA).parquet(path)
    if chunk is not None:
        df = df.where(F.col("chunkId") == chunk)
    return df.select("movieName", "chunkId")


def write_empty_files(spots: DataFrame, root: str) -> int:
    """Zero-length files ``<root>/folder=<folder>/empty-<n>.json.gz`` for the
    rows ``(folder, n)``, written by the executors; returns their number."""
    base = root if "://" in root else re.sub(r"^(file:)?/+", "file:///", root)

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for folder, n in zip(b["folder"], b["n"]):
                files, path = fs.FileSystem.from_uri(f"{base}/folder={folder}/empty-{n}.json.gz")
                files.open_output_stream(path, compression=None).close()
            yield b[["n"]]

    return spots.select("folder", F.col("n").cast("long")).mapInPandas(run, "n long").count()


def evenly(rows: DataFrame) -> DataFrame:
    """Rows for files of bounded, even size: as many files as the data needs at
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes`` (as shuffled) each, as a
    gzip file is written and read by one task whatever its size."""
    return rows.hint("rebalance")


def write_posts_json(posts: DataFrame, path: str, partition_by: list[str] | None = None,
                     files: int | None = None) -> None:
    """Stage posts as gzip JSON lines (the collector's format)."""
    if files:
        posts = posts.repartition(files)
    w = posts.write.mode("overwrite").option("compression", "gzip")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def write_lines_gz(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Stage raw text lines (one column ``value``) as gzip text files."""
    if files:
        lines = lines.repartition(files)
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
