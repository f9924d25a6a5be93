"""Quantiles per movie and day from the partial table's histograms."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from sentimart.plans import daily as PL
from sentimart.session import checkpoint_dir, workspace
from sentimart.sources.fixture import fixture_lexicon, fixture_posts


def classified(spark, rows):
    return spark.createDataFrame(rows, "movieName string, date string, vaderScore double, "
                                 "vaderClassifier double, k string").withColumn(
        "date", F.col("date").cast("date"))


def odd_rows():
    rnd = random.Random(4)
    rows = [(f"[m{rnd.randrange(3)}]", f"2024-01-0{rnd.randrange(1, 4)}",
             round(rnd.choice([rnd.uniform(-1, 1), 0.0, 0.5]), 4), float(rnd.randrange(3)), "a")
            for _ in range(2000)]
    rows += [("[m0, m1]", "2024-01-01", x / 10_000, 1.0, "b") for x in (-10_000, 10_000, 1, -1, 0)]
    return rows + [("[m2]", None, 0.25, 2.0, "a"), ("[lone]", "2024-01-01", None, None, "a")]


@pytest.mark.parametrize("probabilities", [[0.25, 0.5, 0.75], [0.0, 0.001, 0.999, 1.0]])
def test_equal_to_numpy_over_all_scores(spark, probabilities):
    rows = odd_rows()
    partial = PL.partial_aggregate(classified(spark, rows).repartition(5), [], histogram=True)
    names = spark.createDataFrame([(f"m{i}",) for i in range(3)], "movieName string")
    mapping = PL.match_names(partial.select("movieName").distinct(), names)
    got = {(r.movieName, str(r.date)): tuple(r)[1:-1]
           for r in PL.movie_quantiles(partial, mapping, probabilities).collect()}
    by = defaultdict(list)
    for movie, day, score, _, _ in rows:
        for m in ("m0", "m1", "m2"):
            if m in movie and score is not None:
                by[m, str(day)].append(score)
    assert set(got) == set(by)
    for key, scores in by.items():
        assert got[key][:-1] == pytest.approx(np.quantile(scores, probabilities), abs=1e-6)
        assert got[key][-1] == len(scores)


def test_partial_rows_are_the_same_with_and_without(spark):
    df = classified(spark, odd_rows())
    plain = PL.partial_aggregate(df, ["k"])
    wide = PL.partial_aggregate(df.repartition(7), ["k"], histogram=True)
    assert wide.drop("hist").dtypes == plain.dtypes
    assert sorted(map(str, wide.drop("hist").collect())) == sorted(map(str, plain.collect()))
    for r in wide.collect():
        values = [b.v for b in r.hist]
        assert values == sorted(set(values)) and sum(b.n for b in r.hist) == r.n


def test_no_second_scoring_pass(spark):
    lex, mods = fixture_lexicon(spark)
    out = PL.daily_sentiment(fixture_posts(spark, SF_SMALL), lex, mods, quantiles=PL.QUARTILES,
                             order=False)
    plan = out.quantiles._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "documents" not in plan
    assert out.quantiles.count() == out.stats.count() > 0
    out.close()


def test_names_of_the_columns():
    assert PL.quantile_columns([0.05, 0.5, 0.999]) == ["p5Score", "medianScore", "p99_9Score"]


def test_a_workspace_removes_what_was_made_in_it(spark):
    import os

    from sentimart.queries import QUERIES
    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    with workspace(spark):
        for key in ("daily_sentiment", "empty_files", "movie_list_roundtrip", "chunk_daily"):
            assert QUERIES[key](spark, SF_SMALL).count() > 0
        with workspace(spark):
            inner = QUERIES["movie_counts"](spark, SF_SMALL)
            assert inner.count() > 0
        assert set(os.listdir(base)) > before
    assert set(os.listdir(base)) == before
