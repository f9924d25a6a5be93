"""Writers: several runs in one folder, retries, and values that come back."""

import datetime
import os
from collections import Counter

import pytest

from sentimart.schema import COUNTS_SCHEMA, STATS_SCHEMA
from sentimart.sources import sinks as K

DAY = datetime.date(2024, 5, 1)
NAMES = [" a b ", "line\nbreak", "cr\r\nlf\r", 'quo"te', '"quoted"', "com,ma", "back\\slash", '\\"',
         "", None, "'", "tab\t", " é 漢 🙂", "#hash", "null", "a" * 5000, "\n", "x\\"]


def counts(spark, names=NAMES, folder=None):
    rows = [(DAY, float(i % 3), i, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, COUNTS_SCHEMA)
    return df if folder is None else df.selectExpr("*", f"'{folder}' AS folder")


def rows(df):
    return Counter(tuple(r) for r in df.select(*COUNTS_SCHEMA.names).collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_csv_gives_back_what_was_written(spark, tmp_path, parts):
    df = counts(spark).repartition(parts)
    K.write_csv(df, str(tmp_path / "o"))
    assert rows(K.read_counts(spark, str(tmp_path / "o"))) == rows(df)
    stats = spark.createDataFrame([(DAY, -0.5, None, -1.0, 1.0, 3, n) for n in NAMES], STATS_SCHEMA)
    K.write_csv(stats, str(tmp_path / "s"))
    back = K.read_stats(spark, str(tmp_path / "s"))
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, stats.collect()))


def test_partitions_of_other_runs_stay(spark, tmp_path):
    out = str(tmp_path)
    for folder, names in (("a", ["x", "y"]), ("b b", ["z"]), ("a", ["w"])):
        K.write_csv(counts(spark, names, folder), out, ["folder"])
    got = K.read_counts(spark, out, [("folder", "string")]).collect()
    assert {(r.folder, r.movieName) for r in got} == {("a", "w"), ("b b", "z")}


def test_named_files(spark, tmp_path):
    out = str(tmp_path / "daily")
    both = counts(spark, NAMES, "first").unionByName(counts(spark, ["m", "k"], "sec/ond+%"))
    assert K.write_named_csv(both, out, "folder", ["movieName"]) == ["first", "sec/ond+%"]
    assert sorted(f for f in os.listdir(out) if not f.startswith(".")) == ["first.csv", "sec%2Fond+%.csv"]
    before = {f: open(f"{out}/{f}", "rb").read() for f in ("first.csv", "sec%2Fond+%.csv")}
    assert before["sec%2Fond+%.csv"].decode().split("\n")[:2] == [
        "date,vaderClassifier,nTweets,movieName", "2024-05-01,1.0,1,k"]
    # a repeated run changes nothing, another name leaves the rest alone
    K.write_named_csv(both.repartition(5), out, "folder", ["movieName"])
    K.write_named_csv(counts(spark, ["q"], "third"), out, "folder", names=["third", "none"])
    assert {f: open(f"{out}/{f}", "rb").read() for f in before} == before
    assert open(f"{out}/none.csv").read() == "date,vaderClassifier,nTweets,movieName\n"
    back = K.read_named_csv(spark, out, COUNTS_SCHEMA, "folder")
    assert rows(back.where("folder = 'first'")) == rows(counts(spark))
    assert {r.folder for r in back.select("folder").distinct().collect()} == \
        {"first", "sec/ond+%", "third"}
    assert not [f for f in os.listdir(out) if "staging" in f]


def test_a_failed_run_leaves_the_files(spark, tmp_path):
    out = str(tmp_path / "daily")
    K.write_named_csv(counts(spark, ["x"], "a"), out, "folder")
    bad = counts(spark, ["y"], "a").selectExpr(
        "date", "vaderClassifier", "if(nTweets >= 0, raise_error('no'), 1L) AS nTweets", "movieName", "folder")
    with pytest.raises(Exception, match="no"):
        K.write_named_csv(bad, out, "folder")
    assert rows(K.read_named_csv(spark, out, COUNTS_SCHEMA, "folder")) == rows(counts(spark, ["x"]))
    assert [f for f in os.listdir(out) if not f.startswith(".")] == ["a.csv"]


def test_lists_of_several_inputs(spark, tmp_path):
    out, schema = str(tmp_path), "movieName string, chunkId int"
    K.save_movie_list(spark.createDataFrame([("a", 0), ("b", 1)], schema), out, "one")
    K.save_movie_list(spark.createDataFrame([("c", 0)], schema), out, "two")
    K.save_movie_list(spark.createDataFrame([("d", 0)], schema), out, "one")   # shorter now
    assert [tuple(r) for r in K.load_movie_list(spark, out, name="one").collect()] == [("d", 0)]
    assert [tuple(r) for r in K.load_movie_list(spark, out, name="two").collect()] == [("c", 0)]
