"""Quarantine in one scan, counts of dropped rows, listing on any file system."""

import gzip
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sf_paths import SF_SMALL
from sentimart.plans import daily as PL
from sentimart.sources import posts as S
from sentimart.sources.fixture import fixture_lexicon

POST = {"body": "the that", "gnip": {"matching_rules": [{"tag": "m", "value": "q m"}]},
        "postedTime": "2024-01-02T00:00:00Z", "retweetCount": 1, "twitter_lang": "en"}


def lines():
    good = [POST, {**POST, "twitter_lang": "de"}, {**POST, "body": None}, {"info": {"n": 1}},
            {**POST, "twitter_lang": None}, {**POST, "gnip": None}, {**POST, "extra": [1, {}]}]
    text = [json.dumps(p) for p in good] + ["", "   "]
    bad = {"cut off or broken": [json.dumps(POST)[:40], '{"body": "a" "b"}', "{bad json"],
           "not an object": ["line 5", "]", '"text"', "ünï"],
           "wrong type": [json.dumps({**POST, "retweetCount": "many"}), json.dumps({**POST, "gnip": 5})]}
    return text, bad


@pytest.fixture
def folder(tmp_path):
    text, bad = lines()
    for name, part in (("a", text + sum(bad.values(), [])), ("b c", text[:1]), ("none", [])):
        os.makedirs(tmp_path / "in" / name)
        with gzip.open(tmp_path / "in" / name / "x.json.gz", "wt") as f:
            f.write("\n".join(part))
    return str(tmp_path / "in")


def test_quarantine(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):   # a repeated run replaces its own
        good, bad = S.quarantine(spark, folder + "/*", out)
    text, faults = lines()
    assert Counter((os.path.basename(os.path.dirname(r.file)), r.line, r.reason)
                   for r in bad.collect()) == Counter(
        ("a", line, reason) for reason, some in faults.items() for line in some)
    same = S.read_posts(spark, folder + "/*")
    assert sorted(map(str, good.collect())) == sorted(map(str, same.collect()))
    assert good.count() == 8


def test_quarantine_scans_once(spark, folder, tmp_path):
    """One job; the tables are written by the tasks that read the lines."""
    spark.sparkContext.setJobGroup("quarantine", "one scan")
    S.quarantine(spark, folder + "/*", str(tmp_path / "o"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quarantine")
    spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) == 1


def test_intake_counts_come_from_the_job(spark, folder):
    lex, mods = fixture_lexicon(spark)
    raw = S.read_marked(spark, folder + "/*")
    out = PL.daily_sentiment(raw, lex, mods, intake=True, quantiles=PL.QUARTILES)
    got = {r.fate: r.nRows for r in out.intake.collect()}
    assert got == {"malformed": 9, "language": 3, "nulls": 2, "kept": 3}
    plan = out.intake._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "json" not in plan.lower().replace("parquet", "")
    # the outputs are those of the job without the counts
    plain = PL.daily_sentiment(S.read_posts(spark, folder + "/*"), lex, mods, persist=False)
    assert out.counts.collect() == plain.counts.collect() and out.counts.count() > 0
    assert out.stats.collect() == plain.stats.collect()
    out.close()


def test_fates_add_up(spark):
    from sentimart.operators.clean import FATE, clean_posts
    from sentimart.sources.fixture import fixture_posts
    raw = fixture_posts(spark, SF_SMALL)
    marked = clean_posts(raw, mark=True)
    assert marked.count() == raw.count()
    assert marked.where(F.col(FATE) == "kept").count() == clean_posts(raw).count()


def test_listing_is_the_same_by_tasks_driver_and_globs(spark, folder):
    os.makedirs(f"{folder}/a/deep er/x")
    for name in ("a/deep er/x/e.json.gz", "a/z.gz", "none/.hidden.gz", "top.gz", "a/no.txt"):
        open(f"{folder}/{name}", "w").close()
    rows = {}
    for key, root, by_driver in (("plain", folder, False), ("file:", f"file:{folder}", False),
                                 ("file://", f"file://{folder}", False), ("driver", folder, True),
                                 ("list", [f"{folder}/*", folder], False)):
        rows[key] = {(r.folder, r.path, r.length)
                     for r in S.list_files(spark, root, by_driver=by_driver).collect()}
    assert len(set(map(frozenset, rows.values()))) == 1, rows
    short = {(r[0], os.path.relpath(r[1].removeprefix("file:"), folder), r[2] == 0) for r in rows["plain"]}
    assert short == {("in", "top.gz", True), ("a", "a/x.json.gz", False), ("a", "a/z.gz", True),
                              ("x", "a/deep er/x/e.json.gz", True), ("b c", "b c/x.json.gz", False),
                              ("none", "none/x.json.gz", False)}
    assert {os.path.basename(r.path) for r in S.empty_files(spark, folder + "/a*").collect()} == \
        {"z.gz", "e.json.gz"}


def test_schemes_the_tasks_cannot_open(spark, folder):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.store.link./in", f"file://{folder}")
    with pytest.raises(ValueError, match="viewfs://"):
        S.list_files(spark, "viewfs://store/in")
    got = {(r.folder, r.length > 0) for r in S.list_files(spark, "viewfs://store/in", by_driver=True).collect()}
    assert got == {("a", True), ("b c", True), ("none", True)}
    with pytest.raises(FileNotFoundError):
        S.list_files(spark, folder + "/nothing*")
