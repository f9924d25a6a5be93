"""Metamorphic checks of the composed jobs on the sf0.001 fixture posts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from sentimart.operators.match import movie_filter, unique_movies
from sentimart.plans import daily as PL
from sentimart.sources.fixture import fixture_lexicon, fixture_posts


@pytest.fixture(scope="module")
def outputs(spark):
    lex, mods = fixture_lexicon(spark)
    raw = fixture_posts(spark, SF_SMALL)
    out = PL.daily_sentiment(raw, lex, mods)
    counts, stats = out.counts.collect(), out.stats.collect()
    classified = PL.scored_posts(raw, lex, mods).cache()
    yield counts, stats, classified, raw, lex, mods
    classified.unpersist()
    out.close()


def test_equals_per_movie_loop(spark, outputs):
    counts, stats, classified, *_ = outputs
    movies = [r.movieName for r in unique_movies(classified).collect()]
    assert movies
    for m in movies:
        one = movie_filter(classified, m)
        loop = Counter((r.date, r.vaderClassifier, r["count"])
                       for r in one.groupBy("date", "vaderClassifier").count().collect())
        ours = Counter((r.date, r.vaderClassifier, r.nTweets) for r in counts if r.movieName == m)
        assert loop == ours, m
        st = {r.date: r for r in one.groupBy("date").agg(
            F.round(F.stddev_samp("vaderScore"), 6).alias("sd"),
            F.min("vaderScore").alias("mn"), F.count("vaderScore").alias("n")).collect()}
        for r in (r for r in stats if r.movieName == m):
            assert r.totalTweets == st[r.date].n
            assert r.minScore == st[r.date].mn
            if st[r.date].sd is None:
                assert r.stdDev is None
            else:
                assert r.stdDev == pytest.approx(st[r.date].sd, abs=2e-6)


def test_class_counts_sum_to_totals(outputs):
    counts, stats, *_ = outputs
    per = Counter()
    for r in counts:
        per[(r.movieName, r.date)] += r.nTweets
    assert per == Counter({(r.movieName, r.date): r.totalTweets for r in stats})


def test_chunked_equals_unchunked(spark, outputs):
    counts, stats, classified, raw, lex, mods = outputs
    ch = PL.chunked_daily(raw, lex, mods, kind="chicago")
    got = Counter((r.date, r.vaderClassifier, r.nTweets, r.movieName) for r in ch.counts.collect())
    assert got == Counter((r.date, r.vaderClassifier, r.nTweets, r.movieName) for r in counts)
    ch.close()


def test_wide_equals_long(spark, outputs):
    counts, stats, classified, raw, lex, mods = outputs
    wide = PL.daily_summary(raw, lex, mods).collect()
    for r in wide:
        for k in range(3):
            n = sum(c.nTweets for c in counts
                    if c.movieName == r.movieName and c.date == r.date and c.vaderClassifier == k)
            assert r[f"nClass{k}"] == n


def test_contains_equals_like_without_wildcards(spark, outputs):
    counts, stats, classified, raw, lex, mods = outputs
    c = PL.daily_sentiment(raw, lex, mods, match="contains", persist=False)
    assert Counter(tuple(r) for r in c.counts.collect()) == Counter(tuple(r) for r in counts)


def test_no_movies_gives_empty_outputs_with_schema(spark):
    lex, mods = fixture_lexicon(spark)
    raw = fixture_posts(spark, SF_SMALL).where(F.lit(False))
    out = PL.daily_sentiment(raw, lex, mods, persist=False)
    assert out.counts.count() == 0 and out.stats.count() == 0
    assert out.counts.columns == ["date", "vaderClassifier", "nTweets", "movieName"]
    assert out.stats.columns == ["date", "avgScore", "stdDev", "minScore", "maxScore",
                                 "totalTweets", "movieName"]


def test_flagship_plan_shape(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # posts were scored once into the partial table; the output plan only
    # reads that table (no scoring, no scan of the posts)
    assert "MapInArrow" not in plan and "documents.parquet" not in plan


def test_partial_plan_has_one_scan_and_no_sort(spark):
    """The job behind the partial table: score, then one hash aggregate."""
    lex, mods = fixture_lexicon(spark)
    raw = fixture_posts(spark, SF_SMALL, with_folder=True)
    scored = PL.scored_posts(raw, lex, mods, extra_keys=["folder"], keep=["searchPattern"])
    plan = PL.partial_aggregate(scored, ["folder", "searchPattern"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort" not in plan and "Join" not in plan
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1


def test_both_kinds_score_once_and_equal_the_separate_jobs(spark):
    lex, mods = fixture_lexicon(spark)
    raw = fixture_posts(spark, SF_SMALL, with_folder=True)
    tags, values = PL.both_kinds(raw, lex, mods, keys=["folder"])
    alone = PL.daily_sentiment(raw, lex, mods, keys=["folder"], persist=False)
    gnip = PL.chunked_daily(raw.drop("folder"), lex, mods, kind="gnip")
    for a, b in ((tags.counts, alone.counts), (tags.stats, alone.stats),
                 (values.counts, gnip.counts), (values.stats, gnip.stats)):
        assert a.columns == b.columns
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))
        assert "MapInArrow" not in a._jdf.queryExecution().executedPlan().toString()
    tags.close()
    gnip.close()


@pytest.mark.parametrize("kind", ["chicago", "gnip"])
def test_exact_mode_counts_whole_names_only(spark, kind):
    lex, mods = fixture_lexicon(spark)
    raw = fixture_posts(spark, SF_SMALL)
    out = PL.daily_sentiment(raw, lex, mods, kind=kind, match="exact", persist=False)
    classified = PL.scored_posts(raw, lex, mods, kind=kind, keep_arrays=True)
    arrays = [r.tags for r in classified.select("tags").collect()]
    names = {r.movieName for r in out.counts.select("movieName").distinct().collect()}
    total = Counter()
    for arr in arrays:
        for n in set(arr or []):
            if n in names:
                total[n] += 1
    got = Counter()
    for r in out.counts.collect():
        got[r.movieName] += r.nTweets
    assert got == total and names
