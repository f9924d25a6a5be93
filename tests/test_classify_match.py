import random

import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from sentimart.operators.classify import bucket, check_splits, classify
from sentimart.operators.match import match_names, movie_chunks, unique_movies


def test_class_edges(spark):
    vals = [-1.0, -0.5, -0.4999, 0.4999, 0.5, 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "vaderScore double")
    got = [r.vaderClassifier for r in classify(df).collect()]
    assert got == [0.0, 1.0, 1.0, 1.0, 2.0, 2.0, None]


def test_classify_equals_bucketizer(spark):
    rng = random.Random(1)
    vals = [round(rng.uniform(-1, 1), 4) for _ in range(2000)] + [-1.0, 1.0, -1 / 3, 1 / 3]
    for splits in ([-1.0, -0.5, 0.5, 1.0], [-1.0, -0.5, 0.0, 0.5, 1.0],
                   [-1.0, -1 / 3, 1 / 3, 1.0], [-1.0, -0.333, 0.333, 1.0]):
        df = spark.createDataFrame([(v,) for v in vals], "vaderScore double")
        ours = classify(df, thresholds=splits)
        theirs = Bucketizer(splits=splits, inputCol="vaderScore", outputCol="b").transform(ours)
        assert theirs.where(F.col("b") != F.col("vaderClassifier")).count() == 0


@pytest.mark.parametrize("splits", [[-1, 1], [1, 0, -1], [0, 0, 1], [float("nan"), 0, 1]])
def test_invalid_splits(splits):
    with pytest.raises(ValueError):
        check_splits(splits)


@pytest.mark.parametrize("v", [1.5, float("nan")])
def test_out_of_range_raises(spark, v):
    df = spark.createDataFrame([(v,)], "s double")
    with pytest.raises(Exception):
        df.select(bucket(F.col("s"), [-1.0, 0.0, 1.0])).collect()


def _brute(strings, names, mode):
    import fnmatch
    out = set()
    for s in strings:
        for n in names:
            if mode == "contains":
                ok = n in s
            else:
                pat = n.replace("[", "[[]").replace("%", "*").replace("_", "?")
                ok = fnmatch.fnmatchcase(s, "*" + pat + "*")
            if ok:
                out.add((s, n))
    return out


@pytest.mark.parametrize("mode,max_len", [("like", 5), ("contains", 5), ("like", 9),
                                          ("contains", 9)])
def test_gram_join_equals_brute_force(spark, mode, max_len):
    rng = random.Random(5 + max_len)
    alphabet = "ab" if max_len > 5 else "abc"
    names = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, max_len)))
                    for _ in range(80)})
    if mode == "like":
        names += ["a_b", "ab%c", "%", "_", "c_", "abab_abab", "ba%ababab", "__", "%_%", "a", "b"]
    strings = sorted({"[" + ", ".join("".join(rng.choice(alphabet)
                                               for _ in range(rng.randint(1, max_len + 3)))
                                       for _ in range(rng.randint(0, 2))) + "]"
                      for _ in range(200)})
    sdf = spark.createDataFrame([(s,) for s in strings], "movieName string")
    ndf = spark.createDataFrame([(n,) for n in names], "movieName string")
    got = {(r.movieName, r.name) for r in match_names(sdf, ndf, match=mode).collect()}
    assert got == _brute(strings, names, mode)


@pytest.mark.parametrize("shape", ["suffix", "prefix", "both", "short"])
def test_candidates_stay_near_the_matches(spark, shape):
    """300 names that share their ends: the rarest piece is the key."""
    make = {"suffix": lambda i: f"movie{i:03d} lang:en", "prefix": lambda i: f"q src movie{i:03d}",
            "both": lambda i: f"q src {i:03d}x{i * 7 % 300:03d} lang:en",
            "short": lambda i: chr(0x4e00 + i)}[shape]
    names = [make(i) for i in range(300)]
    strings = [f"[{n}]" for n in names] + [f"[{a}, {b}]" for a, b in zip(names, names[1:])]
    sdf = spark.createDataFrame([(s,) for s in strings], "movieName string")
    ndf = spark.createDataFrame([(n,) for n in names], "movieName string")
    got = match_names(sdf, ndf)
    pairs = {(r.movieName, r.name) for r in got.collect()}
    assert pairs == {(s, n) for s in strings for n in names if n in s}
    # the same join before the predicate
    from sentimart.operators import match as M
    grams = sdf.select("movieName", F.explode(M._grams(F.col("movieName"), M.GRAM)).alias("k"))
    n = grams.groupBy("k").agg(F.count("*").alias("n"))
    keyed = (ndf.select("movieName", F.explode(M._pieces(F.col("movieName"), "like", M.GRAM)).alias("k"))
                .join(n, "k").groupBy("movieName").agg(F.min(F.struct("n", "k")).alias("m")))
    assert keyed.agg(F.sum("m.n")).first()[0] <= 3 * len(pairs)


@pytest.mark.parametrize("shape", ["short runs", "long runs", "three runs", "common ends"])
def test_wildcard_names_meet_few_strings(spark, shape):
    """Names of several runs: candidates within twice the matches, though each
    run alone is in a large share of the strings."""
    from sentimart.operators.match import candidates
    rng = random.Random(11)
    if shape == "short runs":
        names = [f"{a}%{b}" for a in "abcdefgh" for b in "stuvwxyz"]
        strings = {"[" + "".join(rng.choice("abcdefghstuvwxyz") for _ in range(4)) + "]"
                   for _ in range(600)}
    elif shape == "long runs":
        words = [f"movie{c}{d}" for c in "abcdefgh" for d in "12"]
        names = [f"{a}%{b}" for a in words for b in words]
        strings = {f"[{rng.choice(words)}, {rng.choice(words)} {i}]" for i in range(600)}
    elif shape == "three runs":
        names = [f"{a}%{b}%{c}" for a in "abcde" for b in "klmno" for c in "vwxyz"]
        strings = {"[" + rng.choice("abcde") + rng.choice("klmno") + rng.choice("vwxyz") + f" {i}]"
                   for i in range(500)}
    else:
        names = [f"the {i:02d}%end" for i in range(60)]
        strings = {f"[the {i % 60:02d} and {i} end]" for i in range(900)}
    strings = sorted(strings)
    sdf = spark.createDataFrame([(s,) for s in strings], "_str string")
    ndf = spark.createDataFrame([(n,) for n in names], "_name string")
    matches = _brute(strings, names, "like")
    found = {(r._str, r._name) for r in candidates(sdf, ndf).collect()}
    assert matches <= found
    assert candidates(sdf, ndf).count() == len(found)
    pieces = 3 if shape == "three runs" else 2    # of three runs two are met
    assert len(found) <= {3: 6, 2: 2}[pieces] * max(len(matches), 1), (len(found), len(matches))
    got = {(r.movieName, r.name) for r in match_names(
        sdf.withColumnRenamed("_str", "movieName"), ndf.withColumnRenamed("_name", "movieName")).collect()}
    assert got == matches


def test_overlapping_runs_of_a_name(spark):
    """The second run must start behind the end of the first."""
    strings = ["[aa]", "[aaa]", "[aba]", "[ab]", "[abcabc]", "[abc]"] + [f"[aa{i}ab]" for i in range(40)]
    names = ["a%a", "aa%a", "ab%ab", "a_a", "abc%abc", "%a%b%", "a%%b", "b%a"]
    sdf = spark.createDataFrame([(s,) for s in strings], "movieName string")
    ndf = spark.createDataFrame([(n,) for n in names], "movieName string")
    got = {(r.movieName, r.name) for r in match_names(sdf, ndf).collect()}
    assert got == _brute(strings, names, "like")


@pytest.mark.parametrize("strings", [["[ab]"], ["[a\\b]"], ["[zz]"]])
def test_backslash_in_a_like_name_always_raises(spark, strings):
    sdf = spark.createDataFrame([(s,) for s in strings], "movieName string")
    ndf = spark.createDataFrame([("a\\b",), ("zz",)], "movieName string")
    with pytest.raises(Exception, match="backslash"):
        match_names(sdf, ndf).collect()
    got = {(r.movieName, r.name) for r in match_names(sdf, ndf, match="contains").collect()}
    assert got == {(s, n) for s in strings for n in ("a\\b", "zz") if n in s}


def test_substring_semantics(spark):
    sdf = spark.createDataFrame([("[src1]",), ("[src10]",), ("[src2, src11]",)], "movieName string")
    ndf = spark.createDataFrame([("src1",), ("src2",)], "movieName string")
    got = sorted((r.movieName, r.name) for r in match_names(sdf, ndf).collect())
    assert got == sorted([("[src1]", "src1"), ("[src10]", "src1"), ("[src2, src11]", "src1"),
                          ("[src2, src11]", "src2")])


def test_exact_mode(spark):
    sdf = spark.createDataFrame([("[src1]", ["src1"]), ("[src10]", ["src10"])],
                                "movieName string, tags array<string>")
    ndf = spark.createDataFrame([("src1",)], "movieName string")
    got = [(r.movieName, r.name) for r in match_names(sdf, ndf, match="exact",
                                                       tags_col="tags").collect()]
    assert got == [("[src1]", "src1")]


def test_unique_movies(spark):
    df = spark.createDataFrame([("[antman]",), ("[captive, sicario]",), ("[]",), ("[null]",),
                                ("[antman]",)], "movieName string")
    got = sorted(r.movieName for r in unique_movies(df).collect())
    assert got == ["antman", "null"]


def test_chunks_23_names(spark):
    names = spark.createDataFrame([(f"m{i:02d}",) for i in range(23)], "movieName string")
    ch = movie_chunks(names).collect()
    sizes = {}
    for r in ch:
        sizes[r.chunkId] = sizes.get(r.chunkId, 0) + 1
    assert sizes == {0: 10, 1: 10, 2: 3}
    order = [r.movieName for r in sorted(ch, key=lambda r: r.movieName)]
    assert [r.chunkId for r in sorted(ch, key=lambda r: r.movieName)] == [i // 10 for i in range(23)]
    assert order == sorted(order)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ordered_row_number_any_partition_count(spark, parts):
    from sentimart.operators.match import ordered_row_number
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(57)], "movieName string")
    got = sorted((r.movieName, r.rn) for r in
                 ordered_row_number(names, "movieName", "rn", partitions=parts).collect())
    assert [rn for _, rn in got] == list(range(1, 58))
