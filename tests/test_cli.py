"""The command-line jobs end to end on staged gzip JSON files."""

import os
from collections import Counter

import pytest

from sf_paths import SF_SMALL
from sentimart.cli import main
from sentimart.plans import daily as PL
from sentimart.sources import sinks as K
from sentimart.sources.fixture import fixture_posts
from sentimart.functions.lexicon import lexicon_frame, modifiers_frame


def test_chunks_then_daily_per_chunk(spark, tmp_path):
    src = str(tmp_path / "twitter-chicago" / "set")
    K.write_posts_json(fixture_posts(spark, SF_SMALL), src, files=2)
    lst = str(tmp_path / "list")
    main(["chunks", "--data-path", src + "/", "--out", lst, "--chunk-size", "7"], spark)
    chunks = K.load_movie_list(spark, lst).collect()
    assert len(chunks) == 20 and max(r.chunkId for r in chunks) == 2
    out = str(tmp_path / "out")
    main(["daily", "--data-path", src + "/", "--out", out, "--movie-list", lst,
          "--thresholds", "-1", "-0.333", "0.333", "1"], spark)
    counts = K.read_counts(spark, out + "/counts/daily")
    assert "chunkId" in counts.columns            # partition folders chunkId=<n>
    counts = counts.select("date", "vaderClassifier", "nTweets", "movieName").collect()
    raw = fixture_posts(spark, SF_SMALL)
    ref = PL.daily_sentiment(raw, lexicon_frame(spark), modifiers_frame(spark),
                             thresholds=[-1, -0.333, 0.333, 1], persist=False)
    assert Counter(tuple(r) for r in counts) == Counter(tuple(r) for r in ref.counts.collect())


def test_daily_by_folder(spark, tmp_path):
    root = str(tmp_path / "twitter-chicago")
    K.write_posts_json(fixture_posts(spark, SF_SMALL, with_folder=True), root,
                       partition_by=["folder"])
    out = str(tmp_path / "out")
    main(["daily", "--data-path", root, "--out", out, "--by-folder"], spark)
    stats = spark.read.option("header", True).csv(out + "/stats/daily")
    assert {r.folder for r in stats.select("folder").distinct().collect()} == \
        {"chicago_0", "chicago_1", "chicago_2"}


def test_two_roots_mixed_kinds_and_a_list_with_folders(spark, tmp_path):
    posts = fixture_posts(spark, SF_SMALL, with_folder=True)
    roots = [str(tmp_path / "twitter-chicago" / r) for r in "ab"]
    K.write_posts_json(posts.where("folder = 'chicago_0'"), roots[0], partition_by=["folder"])
    K.write_posts_json(posts.where("folder <> 'chicago_0'"), roots[1], partition_by=["folder"])
    lst = str(tmp_path / "list")
    main(["chunks", "--data-path", *(f"{r}/*/" for r in roots), "--out", lst], spark)
    assert K.load_movie_list(spark, lst).count() == 20
    outs = []
    for k, extra in enumerate(([], ["--movie-list", lst])):
        out = str(tmp_path / f"out{k}")
        main(["daily", "--data-path", *roots, "--out", out, "--by-folder", *extra], spark)
        outs.append(spark.read.option("header", True).csv(out + "/counts/daily"))
    for out in outs:
        assert {r.folder for r in out.select("folder").distinct().collect()} == \
            {"chicago_0", "chicago_1", "chicago_2"}
    assert "chunkId" in outs[1].columns
    alone = PL.daily_sentiment(posts, lexicon_frame(spark), modifiers_frame(spark),
                               keys=["folder"], persist=False).counts
    got = Counter((r.folder, str(r.date), float(r.vaderClassifier), int(r.nTweets), r.movieName)
                  for r in outs[0].collect())
    assert got == Counter((r.folder, str(r.date), r.vaderClassifier, r.nTweets, r.movieName)
                          for r in alone.collect())
    with pytest.raises(ValueError, match="several kinds"):
        main(["daily", "--data-path", roots[0], str(tmp_path / "twitter-gnip"), "--out", "x"], spark)


def test_daily_leaves_no_folder_behind(spark, tmp_path):
    from sentimart.session import checkpoint_dir
    src, out = str(tmp_path / "twitter-chicago"), str(tmp_path / "out")
    K.write_posts_json(fixture_posts(spark, SF_SMALL), src, files=2)
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    main(["daily", "--data-path", src + "/", "--out", out], spark)
    assert set(os.listdir(base)) == before and os.path.isdir(out + "/stats/daily")


def _read(spark, out, by):
    df = K.read_counts(spark, out + "/counts/daily", by)
    return Counter((str(r.date), r.vaderClassifier, r.nTweets, r.movieName, r[by[0][0]])
                   for r in df.collect())


@pytest.mark.parametrize("files", [[], ["--files"]])
def test_chunks_run_one_after_the_other_into_one_folder(spark, tmp_path, files):
    """Every chunk stays; a repeated run of one changes nothing."""
    src, lst, whole, out = (str(tmp_path / x) for x in ("twitter-gnip", "list", "whole", "out"))
    K.write_posts_json(fixture_posts(spark, SF_SMALL), src, files=2)
    main(["chunks", "--data-path", src + "/", "--out", lst, "--chunk-size", "8"], spark)
    job = ["daily", "--data-path", src + "/", "--movie-list", lst]
    main([*job, "--out", whole], spark)
    for chunk in ("0", "2", "1", "0"):
        main([*job, "--out", out, "--chunk", chunk, *files], spark)
    exp = _read(spark, whole, [("chunkId", "int")])
    assert {k[4] for k in exp} == {0, 1, 2}
    if not files:
        assert _read(spark, out, [("chunkId", "int")]) == exp
        return
    assert sorted(f for f in os.listdir(out + "/stats/daily") if f[0] not in "._") == \
        ["0.csv", "1.csv", "2.csv"]
    from sentimart.schema import COUNTS_SCHEMA
    got = K.read_named_csv(spark, out + "/counts/daily", COUNTS_SCHEMA, "chunk").collect()
    assert Counter((str(r.date), r.vaderClassifier, r.nTweets, r.movieName, int(r.chunk))
                   for r in got) == exp


@pytest.mark.parametrize("files", [[], ["--files"]])
def test_folders_run_one_after_the_other_into_one_folder(spark, tmp_path, files):
    posts, out = fixture_posts(spark, SF_SMALL, with_folder=True), str(tmp_path / "out")
    for k in "01":
        src = str(tmp_path / f"twitter-chicago/set {k}")
        K.write_posts_json(posts.where(f"folder = 'chicago_{k}'").drop("folder"), src, files=2)
        main(["daily", "--data-path", src + "/", "--out", out, "--min-partitions", "3", *files], spark)
    names = [f for f in os.listdir(out + "/counts/daily") if f[0] not in "._"]
    assert sorted(names) == ([f"set {k}.csv" for k in "01"] if files else
                             [f"folder=set {k}" for k in "01"])


def test_language_of_the_job(spark, tmp_path):
    src, out = str(tmp_path / "twitter-chicago"), str(tmp_path / "out")
    K.write_posts_json(fixture_posts(spark, SF_SMALL), src, files=2)
    main(["daily", "--data-path", src + "/", "--out", out, "--lang", "de"], spark)
    got = K.read_counts(spark, out + "/counts/daily", [("folder", "string")])
    ref = PL.daily_sentiment(fixture_posts(spark, SF_SMALL), lexicon_frame(spark),
                             modifiers_frame(spark), lang="de", persist=False).counts
    assert got.count() == ref.count() > 0
