"""Command-line jobs for ``spark-submit``.

    zip -r sentimart.zip sentimart
    spark-submit --py-files sentimart.zip sentimart/cli.py daily --data-path ROOT/ --out OUT
                 [--by-folder] [--thresholds -1 -0.333 0.333 1] [--movie-list LIST [--chunk N]]
                 [--lexicon lexicon.tsv] [--modifiers modifiers.tsv] [--kind gnip]
                 [--lang en] [--min-partitions 200] [--files]
    spark-submit --py-files sentimart.zip sentimart/cli.py chunks --data-path ROOT/ --out LIST
                 [--chunk-size 10] [--list-name NAME] [--lang en]

``daily`` writes ``OUT/counts/daily`` and ``OUT/stats/daily``: CSV with
header, partitioned by ``folder`` and, with a movie list, by ``chunkId``.
Without ``--by-folder`` the folder is named after the data path. With
``--files`` every folder or chunk is one file ``<folder>.csv`` or
``<chunk>.csv`` instead. Runs of other folders or chunks into the same OUT are
left alone; a repeated run replaces its own. ``chunks`` finds the movies in the
data and saves the movie list table ``(movieName, chunkId)``. Both run as one
Spark job over all folders / chunks. ``--min-partitions`` spreads the posts of
a few large files over that many tasks before they are scored.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

if __package__ in (None, ""):  # run as a script by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sentimart.functions.lexicon import (lexicon_frame, load_lexicon, load_modifiers,
                                         modifiers_frame)
from sentimart.operators.clean import clean_posts, kind_from_path
from sentimart.operators.match import movie_chunks, unique_movies
from sentimart.plans.daily import daily_sentiment
from sentimart.schema import CHUNK_SIZE, THRESHOLDS_DEFAULT
from sentimart.sources.posts import read_folders, read_posts
from sentimart.sources.sinks import (load_movie_list, save_movie_list, write_daily,
                                     write_daily_files)


def _session(app: str) -> SparkSession:
    spark = SparkSession.builder.appName(app).getOrCreate()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def _word_tables(spark, args):
    lex = load_lexicon(spark, args.lexicon) if args.lexicon else lexicon_frame(spark)
    mods = load_modifiers(spark, args.modifiers) if args.modifiers else modifiers_frame(spark)
    return lex, mods


def _kind(args) -> str:
    """The kind given, or the one that all paths agree on."""
    if args.kind:
        return args.kind
    kinds = {kind_from_path(p) for p in args.data_path}
    if len(kinds) > 1:
        raise ValueError(f"the paths are of several kinds ({', '.join(sorted(kinds))}); run one "
                         "job per kind or give --kind")
    return kinds.pop()


def run_daily(spark: SparkSession, args) -> None:
    kind = _kind(args)
    lex, mods = _word_tables(spark, args)
    if args.by_folder:
        raw = read_folders(spark, args.data_path)
        keys = ["folder"]
    else:
        raw = read_posts(spark, args.data_path)
        keys = []
    movies, extra = None, []
    if args.movie_list:
        movies = load_movie_list(spark, args.movie_list, args.chunk, args.list_name)
        extra = ["chunkId"]
    out = daily_sentiment(raw, lex, mods, kind=kind, thresholds=args.thresholds,
                          movies=movies, match=args.match, keys=keys, name_extra=extra,
                          lang=args.lang, min_partitions=args.min_partitions)
    try:
        _write(args, out, movies)
    finally:
        out.close()


def path_name(paths: list[str]) -> str:
    """What a run over whole paths is called: their last folders."""
    return "+".join(p.rstrip("/").rstrip("*").rstrip("/").split("/")[-1] for p in paths)


def _write(args, out, movies) -> None:
    counts, stats, names = out.counts, out.stats, None
    if not args.by_folder and not args.movie_list:
        folder = path_name(args.data_path)
        counts, stats = (df.withColumn("folder", F.lit(folder)) for df in (counts, stats))
        names = [folder]
    part_by = [c for c in ("folder", "chunkId") if c in counts.columns]
    if not args.files:
        if args.movie_list and args.chunk is not None and not args.by_folder:
            # the chunk is replaced even if it has no rows any more
            write_daily(counts.drop("chunkId"), stats.drop("chunkId"), args.out,
                        single_file=args.single_file, below=f"chunkId={args.chunk}")
        else:
            write_daily(counts, stats, args.out, partition_by=part_by,
                        single_file=args.single_file)
        return
    if args.movie_list and not args.by_folder:
        # one name per chunk, as many as the list has
        names = [str(r.chunkId) for r in movies.select("chunkId").distinct().collect()]
    name = part_by[0]
    if len(part_by) > 1:
        file = F.concat_ws("-", *part_by)
        counts, stats = (df.withColumn("file", file).drop(*part_by) for df in (counts, stats))
        name = "file"
    write_daily_files(counts, stats, args.out, name, names)


def run_chunks(spark: SparkSession, args) -> None:
    kind = _kind(args)
    raw = read_posts(spark, args.data_path)
    names = unique_movies(clean_posts(raw, kind=kind, lang=args.lang).select("movieName"))
    save_movie_list(movie_chunks(names, args.chunk_size), args.out, args.list_name)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sentimart")
    sub = p.add_subparsers(dest="cmd", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--data-path", nargs="+", required=True)
    common.add_argument("--kind", choices=["chicago", "gnip"])
    common.add_argument("--lexicon")
    common.add_argument("--modifiers")
    common.add_argument("--out", required=True)
    common.add_argument("--lang", default="en")
    common.add_argument("--list-name")
    d = sub.add_parser("daily", parents=[common])
    d.add_argument("--thresholds", nargs="+", type=float, default=THRESHOLDS_DEFAULT)
    d.add_argument("--movie-list")
    d.add_argument("--chunk", type=int)
    d.add_argument("--match", choices=["like", "contains", "exact"], default="like")
    d.add_argument("--by-folder", action="store_true")
    d.add_argument("--single-file", action="store_true")
    d.add_argument("--files", action="store_true")
    d.add_argument("--min-partitions", type=int)
    c = sub.add_parser("chunks", parents=[common])
    c.add_argument("--chunk-size", type=int, default=CHUNK_SIZE)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or _session(f"sentimart-{args.cmd}")
    t0 = time.time()
    (run_daily if args.cmd == "daily" else run_chunks)(spark, args)
    print(f"{args.cmd} finished in {(time.time() - t0) / 60:.2f} minutes")


if __name__ == "__main__":
    main(sys.argv[1:])
