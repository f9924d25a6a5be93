"""Readers for JSON-lines post dumps.

Posts are read with a declared schema: no inference pass over the data,
and a folder that never mentions a field still yields the column. Gzip
files are not splittable, so a folder of few large files gives few tasks;
``min_partitions`` redistributes rows after the scan when that matters
(the redistribution is a round-robin shuffle, deterministic on retry).
"""

from __future__ import annotations

import fnmatch
import re
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart.operators.score import spread
from sentimart.schema import CORRUPT_COLUMN, POST_SCHEMA, POST_SCHEMA_WITH_CORRUPT


GZ_GLOB = "*.gz"


def _reader(spark: SparkSession, schema, mode: str, glob: str | None, recursive: bool):
    r = spark.read.schema(schema).option("mode", mode)
    if mode == "PERMISSIVE":
        r = r.option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r


def read_posts(spark: SparkSession, paths: str | list[str], glob: str | None = GZ_GLOB,
               drop_malformed: bool = True, recursive: bool = False,
               min_partitions: int | None = None) -> DataFrame:
    """Posts from one or more folders of JSON lines (gzip by default).

    Malformed lines are dropped (``DROPMALFORMED``).
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    df = _reader(spark, POST_SCHEMA, mode, glob, recursive).json(paths)
    return spread(df, min_partitions)


def split_malformed(spark: SparkSession, paths: str | list[str], glob: str | None = GZ_GLOB,
                    recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: (good posts, bad lines). Bad lines keep their raw text in
    ``_corrupt_record``; good rows have it NULL. The bad side also carries
    ``body`` because Spark refuses a query on the corrupt column alone."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = _reader(spark, POST_SCHEMA_WITH_CORRUPT, "PERMISSIVE", glob, recursive).json(paths)
    bad_flag = F.col(CORRUPT_COLUMN).isNotNull()
    # Always true, but it keeps ``body`` in the scan's required columns so a
    # count on either side is not a query on the corrupt column alone.
    keep_body = F.length(F.coalesce(F.col(CORRUPT_COLUMN), F.col("body"), F.lit(""))) >= 0
    good = df.where(~bad_flag & keep_body).drop(CORRUPT_COLUMN)
    bad = df.where(bad_flag & keep_body).select(CORRUPT_COLUMN, "body")
    return good, bad


def read_marked(spark: SparkSession, paths: str | list[str], glob: str | None = GZ_GLOB,
                recursive: bool = False) -> DataFrame:
    """All lines: posts, and malformed lines with their text in
    ``_corrupt_record`` (null for posts)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return _reader(spark, POST_SCHEMA_WITH_CORRUPT, "PERMISSIVE", glob, recursive).json(paths)


def quarantine(spark: SparkSession, paths: str | list[str], out: str, glob: str | None = GZ_GLOB,
               recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """S3: ONE scan that writes the good posts and the bad lines to two tables,
    ``<out>/side=good`` and ``<out>/side=bad``; returns both, read back.

    Bad lines have their ``file``, the raw ``line`` and a ``reason``: ``not an
    object`` (the line does not start with a brace), ``cut off or broken`` (no
    JSON) or ``wrong type`` (JSON, but a field does not fit the schema). Blank
    lines are neither. The folder is replaced as a whole."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    lines = r.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    post = F.from_json("line", POST_SCHEMA_WITH_CORRUPT,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN})
    rows = lines.where(F.trim("line") != "").withColumn("post", post)
    bad = F.col("post").isNull() | F.col(f"post.{CORRUPT_COLUMN}").isNotNull()
    reason = (F.when(~F.trim("line").startswith("{"), "not an object")
               .when(F.try_parse_json("line").isNull(), "cut off or broken").otherwise("wrong type"))
    fields = [F.when(~bad, F.col(f"post.{c}")).alias(c) for c in POST_SCHEMA.names]
    rows = rows.select(*fields, F.when(bad, F.col("file")).alias("file"),
                       F.when(bad, F.col("line")).alias("line"), F.when(bad, reason).alias("reason"),
                       F.when(bad, "bad").otherwise("good").alias("side"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("side").parquet(out)
    written = spark.read.schema(rows.schema).parquet(out)
    return (written.where("side = 'good'").select(*POST_SCHEMA.names),
            written.where("side = 'bad'").select("file", "line", "reason"))


def read_folders(spark: SparkSession, root: str | list[str], glob: str | None = GZ_GLOB,
                 folder_depth: int = 1) -> DataFrame:
    """Every folder below ``root`` (one or more) in one scan, with a
    ``folder`` column taken from each row's file path (``_metadata.file_path``)."""
    df = _reader(spark, POST_SCHEMA, "DROPMALFORMED", glob, recursive=True).json(root)
    return df.withColumn("folder", folder_of(F.col("_metadata.file_path"), folder_depth))


def folder_of(path, depth: int = 1):
    """Name of the folder ``depth`` levels above the file (a ``key=`` prefix,
    as written by partitioned writers, is dropped)."""
    parts = F.split(path, "/")
    return F.regexp_replace(F.element_at(parts, F.lit(-1 - depth)), r"^[^=]*=", "")


# Schemes of the reader's file systems and the names under which
# the executors' Python opens the same storage.
_OPENED_AS = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs",
              "abfs": "abfs", "abfss": "abfss"}


def _statuses(spark: SparkSession, root: str):
    """File system of a root and what the root, which may be a glob, stands
    for: as the reader resolves it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(path)
    if found is None or not len(found):
        raise FileNotFoundError(f"no such file or folder: {root}")
    return files, list(found)


def _wanted(name: str, glob: str | None) -> bool:
    return not name.startswith((".", "_")) and (not glob or fnmatch.fnmatch(name, glob))


def list_files(spark: SparkSession, roots: str | list[str], glob: str | None = GZ_GLOB,
               by_driver: bool = False) -> DataFrame:
    """``(folder, path, length)`` for every file below the roots.

    File scans skip zero-length files, so the files are listed. Roots and globs
    are resolved by the file system that the reader uses; the driver names the
    folders right below each root, one task lists a folder with all below it,
    and files stay rows of a distributed table. Contents are never read.

    Tasks open local, HDFS, S3 (``s3a`` and the like), GCS and Azure storage.
    Any other scheme that the reader takes is refused by name, unless
    ``by_driver`` is set: then the driver lists it through the reader's own file
    system, as Spark does for any read of it."""
    folders, rows = [], []
    for root in [roots] if isinstance(roots, str) else list(roots):
        files, found = _statuses(spark, root)
        for top in found:
            scheme = top.getPath().toUri().getScheme() or "file"
            if scheme not in _OPENED_AS and not by_driver:
                raise ValueError(f"tasks can't list {scheme}:// ({root}); set by_driver=True, or use "
                                 f"one of {', '.join(sorted(_OPENED_AS))}")
            below = files.listStatus(top.getPath()) if top.isDirectory() else [top]
            for x in below:
                name = x.getPath().getName()
                if x.isFile():
                    if _wanted(name, glob):
                        rows.append((x.getPath().toString(), x.getLen()))
                elif name.startswith((".", "_")):
                    continue
                elif scheme in _OPENED_AS and not by_driver:
                    folders.append((scheme, x.getPath().toString()))
                else:
                    deep = files.listFiles(x.getPath(), True)
                    while deep.hasNext():
                        f = deep.next()
                        if _wanted(f.getPath().getName(), glob):
                            rows.append((f.getPath().toString(), f.getLen()))

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for scheme, uri in zip(b["scheme"], b["path"]):
                rest = re.sub(r"^[a-z0-9]+:/*", "", uri)
                opened = _OPENED_AS[scheme] + (":///" if scheme == "file" else "://")
                files, path = fs.FileSystem.from_uri(opened + quote(rest, safe="/:@"))
                found = [x for x in files.get_file_info(fs.FileSelector(path, recursive=True))
                         if x.type == fs.FileType.File and _wanted(x.base_name, glob)]
                start = "file:/" if scheme == "file" else f"{scheme}://"
                yield pd.DataFrame({"path": [start + x.path.lstrip("/") for x in found],
                                    "length": [x.size for x in found]}).astype(
                                        {"path": str, "length": "int64"})

    schema = "path string, length long"
    listed = spark.createDataFrame(rows, schema)
    if folders:
        table = spark.createDataFrame(folders, "scheme string, path string")
        listed = listed.unionByName(
            table.repartition(len(folders)).mapInPandas(run, schema))
    return listed.distinct().select(folder_of(F.col("path")).alias("folder"), "path", "length")


def empty_files(spark: SparkSession, roots: str | list[str], glob: str | None = GZ_GLOB,
                by_driver: bool = False) -> DataFrame:
    """Zero-length files below the roots (reported, never deleted)."""
    return list_files(spark, roots, glob, by_driver).where(F.col("length") == 0)


def file_report(spark: SparkSession, roots: str | list[str], glob: str | None = GZ_GLOB,
                by_driver: bool = False) -> DataFrame:
    """Per folder, files, empty files and bytes."""
    return list_files(spark, roots, glob, by_driver).groupBy("folder").agg(
        F.count(F.lit(1)).alias("nFiles"),
        F.count(F.when(F.col("length") == 0, True)).alias("nEmpty"),
        F.sum("length").alias("bytes"),
    )
