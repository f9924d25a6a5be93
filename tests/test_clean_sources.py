import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F

from sentimart.functions.dates import lenient_date
from sentimart.operators.clean import clean_posts, kind_from_path
from sentimart.sources import posts as S
from sentimart.sources import sinks as K


def _post(body="good", tags=("antman",), time="2015-07-17T10:00:00.000Z", lang="en", rt=1):
    rules = None if tags is None else [{"tag": t, "value": "q " + str(t)} for t in tags]
    d = {"body": body, "postedTime": time, "retweetCount": rt, "twitter_lang": lang,
         "actor": {"id": "x"}}
    if rules is not None:
        d["gnip"] = {"matching_rules": rules}
    return d


def _write_gz(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as f:
        for line in lines:
            f.write(line + "\n")


def test_clean_rules(spark, tmp_path):
    lines = [json.dumps(_post()),
             json.dumps(_post(tags=("captive", "sicario"))),
             json.dumps(_post(tags=(None,))),
             json.dumps(_post(tags=())),
             json.dumps(_post(tags=None)),
             json.dumps(_post(lang="es")),
             json.dumps({"info": {"activity_count": 3}}),
             "{bad json",
             json.dumps(_post(time="garbage")),
             json.dumps(_post(time="2015-07-17T23:59:59.000Z")),
             json.dumps(_post(time="2015-07-17T23:59:59-08:00"))]
    _write_gz(str(tmp_path / "chicago" / "a.json.gz"), lines)
    raw = S.read_posts(spark, str(tmp_path / "chicago") + "/")
    rows = clean_posts(raw, "chicago").collect()
    names = sorted(r.movieName for r in rows)
    assert "[antman]" in names and "[captive, sicario]" in names
    assert "[null]" in names and "[]" in names
    assert len(rows) == 7          # es, non-post, malformed and no-gnip rows dropped
    dates = [r.date for r in rows]
    assert None in dates            # bad date kept with a NULL date
    assert dates.count(dt.date(2015, 7, 17)) == 6
    gn = clean_posts(raw, "gnip").collect()
    assert {r.movieName for r in gn} >= {"[q antman]"}


def test_kind_from_path():
    assert kind_from_path("/data/twitter-gnip/downloads/") == "gnip"
    assert kind_from_path("/data/twitter-chicago/set9/") == "chicago"
    import pytest
    with pytest.raises(ValueError):
        kind_from_path("/data/other/")


def test_malformed_split_and_empty_file(spark, tmp_path):
    _write_gz(str(tmp_path / "f1" / "a.json.gz"), [json.dumps(_post()), "{bad json"])
    open(tmp_path / "f1" / "empty.json.gz", "wb").close()
    root = str(tmp_path / "f1") + "/"
    assert S.read_posts(spark, root).count() == 1
    good, bad = S.split_malformed(spark, root)
    assert good.count() == 1 and len(bad.collect()) == 1
    empties = S.empty_files(spark, str(tmp_path)).collect()
    assert [os.path.basename(r.path) for r in empties] == ["empty.json.gz"]
    open(tmp_path / "top.json.gz", "wb").close()
    report = {r.folder: (r.nFiles, r.nEmpty) for r in S.file_report(spark, str(tmp_path)).collect()}
    assert report == {"f1": (2, 1), tmp_path.name: (1, 1)}


def test_many_folders_with_folder_column(spark, tmp_path):
    for f, n in (("chicago_a", 2), ("chicago_b", 3)):
        _write_gz(str(tmp_path / f / "p.json.gz"), [json.dumps(_post())] * n)
    df = S.read_folders(spark, str(tmp_path))
    got = {r.folder: r.c for r in df.groupBy("folder").agg(F.count("*").alias("c")).collect()}
    assert got == {"chicago_a": 2, "chicago_b": 3}


def test_csv_and_movie_list_roundtrip(spark, tmp_path):
    from sentimart.schema import COUNTS_SCHEMA
    counts = spark.createDataFrame([(dt.date(2015, 7, 17), 1.0, 5, "antman")], COUNTS_SCHEMA)
    K.write_csv(counts, str(tmp_path / "c"), single_file=True)
    back = K.read_counts(spark, str(tmp_path / "c")).collect()
    assert back == counts.collect()
    ml = spark.createDataFrame([("antman", 0), ("zed", 1)], "movieName string, chunkId int")
    K.save_movie_list(ml, str(tmp_path / "ml"))
    assert sorted(K.load_movie_list(spark, str(tmp_path / "ml")).collect()) == sorted(ml.collect())
    assert [r.movieName for r in K.load_movie_list(spark, str(tmp_path / "ml"), chunk=1).collect()] == ["zed"]


def test_lenient_date(spark):
    vals = ["2015-07-17T23:59:59.000Z", "07/17/2015", "Fri Jul 17 20:01:02 +0000 2015",
            "17 Jul 2015", "2015/07/17", "garbage", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r.d for r in df.select(lenient_date(F.col("s")).alias("d")).collect()]
    assert got == [dt.date(2015, 7, 17)] * 5 + [None, None]
