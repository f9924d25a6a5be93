import random

import pytest
from pyspark.sql import functions as F

from brute import score as brute_score
from sentimart.functions.lexicon import (SEED_LEXICON, lexicon_frame, modifiers_frame,
                                         seed_modifier_rows)
from sentimart.operators.score import score_text

LEX = dict(SEED_LEXICON)
MODS = seed_modifier_rows()


def _score(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = score_text(df, lexicon_frame(spark), modifiers_frame(spark), text_col="text",
                     all_scores=True)
    rows = {r.id: (r.neg, r.neu, r.pos, r.vaderScore) for r in out.collect()}
    return [rows[i] for i in range(len(texts))]


def test_one_rule_each(spark):
    texts = ["good", "GOOD day", "very good", "not good", "good but bad", "good!!!", ""]
    got = dict(zip(texts, _score(spark, texts)))
    comp = {t: v[3] for t, v in got.items()}
    assert comp[""] == 0.0 and got[""] == (0.0, 0.0, 0.0, 0.0)
    assert comp["good"] > 0
    assert comp["GOOD day"] > comp["good"]            # caps
    assert comp["very good"] > comp["good"]           # booster
    assert comp["not good"] < 0                       # negation
    assert comp["good but bad"] < 0                   # but weighting
    assert comp["good!!!"] > comp["good"]             # emphasis
    for t in texts:
        assert got[t] == pytest.approx(brute_score(t, LEX, MODS), abs=1e-9)


def test_idioms_and_caps_boosters(spark):
    texts = ["good day", "VERY good day", "very good day", "least good", "at least good",
             "kind of good", "never so good", "never good", "never this good", "so good",
             "the very least good", "KIND OF bad day", "never so bad", "least the good",
             "sort of not good", "not never so good", "a never so much good"]
    got = dict(zip(texts, _score(spark, texts)))
    comp = {t: v[3] for t, v in got.items()}
    assert comp["VERY good day"] > comp["very good day"] > comp["good day"]
    assert comp["least good"] < 0 < comp["at least good"] and comp["least the good"] > 0
    assert comp["kind of good"] < comp["good day"]
    assert comp["never so good"] > comp["so good"] and comp["never good"] < 0
    for t in texts:
        assert got[t] == pytest.approx(brute_score(t, LEX, MODS), abs=1e-9), t


def test_all_caps_text_has_no_caps_boost(spark):
    a, b = _score(spark, ["GOOD MOVIE"])[0], _score(spark, ["good movie"])[0]
    assert a[3] == b[3]


def test_lexicon_word_is_not_a_modifier(spark):
    # "bad" precedes "good" and is in the lexicon: no booster/negation effect
    assert _score(spark, ["never bad good"])[0] == pytest.approx(
        brute_score("never bad good", LEX, MODS))


def test_emoticons_and_punctuation(spark):
    texts = [":) great", "great!!", "(ok) :(", "...hello... :d", "?? good ??", "good????"]
    for t, got in zip(texts, _score(spark, texts)):
        assert got == pytest.approx(brute_score(t, LEX, MODS), abs=1e-9)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(7)
    vocab = ([w for w, _ in SEED_LEXICON[:40]] + [w for w, _, _ in MODS[:20]]
             + [w for t, _, _ in MODS if " " in t for w in t.split()] + ["least", "VERY", "SO"]
             + ["but", "movie", "the", "a", "it", "was", "n't", "don't", "GOOD", "BAD"]
             + ["!", "?", ":)", "great!!", "(bad)", "Very"])
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    for t, got in zip(texts, _score(spark, texts)):
        exp = brute_score(t, LEX, MODS)
        assert got[3] == pytest.approx(exp[3], abs=1.01e-4), t
        assert got[:3] == pytest.approx(exp[:3], abs=1.01e-3), t


def test_score_properties(spark):
    rng = random.Random(3)
    vocab = [w for w, _ in SEED_LEXICON] + ["x", "y", "not", "very", "but"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for neg, neu, pos, comp in _score(spark, texts):
        assert -1.0 <= comp <= 1.0
        assert neg + neu + pos == pytest.approx(1.0, abs=2e-3)


def test_sign_symmetry(spark):
    lex = [("up", 2.0), ("down", -2.0)]
    df = spark.createDataFrame([(0, "very up"), (1, "very down")], "id long, text string")
    out = score_text(df, lexicon_frame(spark, lex), modifiers_frame(spark),
                     text_col="text").orderBy("id").collect()
    assert out[0].vaderScore == -out[1].vaderScore


def test_all_columns_and_rows_are_kept(spark):
    df = spark.createDataFrame([("a", "good", 1), ("b", "bad", 2), ("b", "bad", 2), (None, None, 3)],
                               "k string, body string, neg int")
    out = score_text(df, lexicon_frame(spark), modifiers_frame(spark))
    assert out.columns == ["k", "body", "neg", "vaderScore"]
    assert out.count() == 4          # identical rows stay separate posts
    every = score_text(df, lexicon_frame(spark), modifiers_frame(spark), all_scores=True)
    assert every.columns == ["k", "body", "neg", "neu", "pos", "vaderScore"]
    some = score_text(df, lexicon_frame(spark), modifiers_frame(spark), keep=["k"])
    assert some.columns == ["k", "vaderScore"]


def test_equal_and_opposite_words_cancel_exactly(spark):
    lex = [("up", 0.1), ("more", 0.2), ("down", -0.3)]
    df = spark.createDataFrame([("up more down!!!",), ("down up more!!!",)], "body string")
    out = score_text(df, lexicon_frame(spark, lex), modifiers_frame(spark)).collect()
    assert [r.vaderScore for r in out] == [0.0, 0.0]


def scoring_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_moves_nothing(spark):
    """The scoring itself: no shuffle, sort, join or explode."""
    from sentimart.plans.daily import scored_posts
    from sentimart.sources.fixture import fixture_lexicon, fixture_posts
    from sf_paths import SF_SMALL
    lex, mods = fixture_lexicon(spark)
    for kw in ({}, {"extra_keys": ["folder"]}, {"kind": "gnip", "keep_arrays": True}):
        raw = fixture_posts(spark, SF_SMALL, with_folder=True)
        plan = scoring_plan(scored_posts(raw, lex, mods, **kw))
        for node in ("Exchange", "Sort", "Join", "Generate", "Window", "BatchEvalPython"):
            assert node not in plan, (node, kw)
        assert plan.count("MapInArrow") == 1


def test_building_a_plan_starts_no_job(spark):
    grouped = spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(
        F.max(F.col("id").cast("string")).alias("body"))
    tracker, group = spark.sparkContext.statusTracker(), "score-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        score_text(grouped, lexicon_frame(spark), modifiers_frame(spark), min_partitions=4)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_word_list_above_the_limit(spark):
    """Only the words that occur are shipped; too many of those raise."""
    words = [(f"w{i}", 1.0 if i % 2 else -1.0) for i in range(5000)]
    lex = spark.createDataFrame(words, "token string, valence double")
    texts = [(f"W{i}! but not (w{i + 1})",) for i in range(60)]
    df = spark.createDataFrame(texts, "body string")
    mods = modifiers_frame(spark)
    want = score_text(df, lex, mods, all_scores=True).collect()
    cut = score_text(df, lex, mods, all_scores=True, max_words=100).collect()
    assert sorted(cut) == sorted(want)
    with pytest.raises(ValueError, match="max_words"):
        score_text(df, lex, mods, max_words=50)
    from sentimart.operators.score import occurring
    plan = scoring_plan(occurring(lex, df, "body"))
    # tokens are combined before they move, so a frequent word is a few rows
    assert plan.index("HashAggregate") < plan.rindex("Exchange") and "Python" not in plan


def test_entries_of_wrong_shape_raise(spark):
    df = spark.createDataFrame([("good",)], "body string")
    for bad in ([(" ", "booster", 1.0)], [("a b", "negation", 0.0)], [("a", "amplifier", 2.0)]):
        with pytest.raises(ValueError):
            score_text(df, lexicon_frame(spark), modifiers_frame(spark, bad))


def test_tokens_match_per_token_rules(spark):
    from brute import _strip
    from sentimart.functions.text import tokens
    cases = ["great!!", ":)", "!!!", "a!", "don't", "...hello...", "'ok'", "", "  lead trail  ",
             "(a)", "(abc)", "GOOD day", "STRAßE ok", "A1 b", "!!WOW!! x", "e.g.", "--a-b--",
             "¡hola!", "é!!", "tab\there", "«quoted»", "ÉTÉ été", "I AM", "\\back\\ [x]"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", tokens(F.col("t")).alias("toks")).collect():
        assert r.toks == [_strip(t) for t in r.t.split() if t], r.t


def test_load_lexicon_keeps_every_token(spark, tmp_path):
    rows = ['"\t1.0', '"quoted\t2.0\t0.5', "good\t1.9", "Good\t3.3", "a\\b\t-1.0", "#x\t0.5",
            "bad line", "\t2.0", "nan\tx"]
    (tmp_path / "lex.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    from sentimart.functions.lexicon import load_lexicon, load_modifiers
    got = [{r.token: r.valence for r in load_lexicon(spark, str(tmp_path)).collect()}
           for _ in range(2)]
    assert got[0] == got[1] == {'"': 1.0, '"quoted': 2.0, "good": 2.6, "a\\b": -1.0, "#x": 0.5}
    (tmp_path / "mods").mkdir()
    (tmp_path / "mods" / "m.tsv").write_text('"so\tbooster\t0.3\nkind of\tBooster\t-0.3\nx\tother\n')
    mods = sorted(tuple(r) for r in load_modifiers(spark, str(tmp_path / "mods")).collect())
    assert mods == [('"so', "booster", 0.3), ("kind of", "booster", -0.3)]


def test_seed_list_follows_its_rule():
    from sentimart.functions.lexicon import SEED_GROUPS, SEED_STRENGTHS
    assert {abs(v) for _, v in SEED_LEXICON} == set(SEED_STRENGTHS.values())
    words = [w for ws in SEED_GROUPS.values() for w in ws.split()]
    assert len(words) == len(set(words)) == len(SEED_LEXICON)


PHRASE_LEX = {"good": 2.0, "bad": -2.0, "death": -2.5, "kiss": 1.5, "half": 0.4, "grinning": 1.2,
              "ok": 0.5}
PHRASE_IDIOMS = {"kiss of death": -1.5, "not half bad": 1.8, "good for now": 0.7,
                 "now and then good for": -0.3, "death of": 0.9}
PHRASE_MODS = [("very", "booster", 0.293), ("not", "negation", 0.0), ("never", "negation", 0.0),
               ("least", "negation_near", 0.0), ("kind of", "booster", -0.293),
               ("to the very", "booster", 0.6), ("not in the least", "amplifier", -0.6),
               ("never ever in my life", "amplifier", 1.4), ("never ever", "booster", 0.1),
               ("in my life", "booster", 0.2), ("ever in", "amplifier", 1.05),
               ("\U0001F600 grinning face", "emoji", 0.0), ("\U0001F600\U0001F600 very", "emoji", 0.0),
               ("\u2639 bad", "emoji", 0.0)]


def _phrase_scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lex = lexicon_frame(spark, [*PHRASE_LEX.items(), *PHRASE_IDIOMS.items()])
    out = score_text(df, lex, modifiers_frame(spark, PHRASE_MODS), text_col="text", all_scores=True)
    rows = {r.id: (r.neg, r.neu, r.pos, r.vaderScore) for r in out.collect()}
    return [rows[i] for i in range(len(texts))]


def test_phrases_idioms_and_emoji_equal_brute_force(spark):
    rnd = random.Random(9)
    words = ("good bad death kiss of half grinning ok very not never least kind to the in my life "
             "ever for now and then but \U0001F600 \U0001F600\U0001F600 \u2639 x VERY Good! (death)").split()
    pieces = words + [*PHRASE_IDIOMS, *[m[0] for m in PHRASE_MODS if m[1] != "emoji"]] * 2
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 9))) for _ in range(600)]
    texts += ["good\U0001F600bad", "\U0001F600\U0001F600\U0001F600", "", None, "kiss of death"] * 2
    got = _phrase_scores(spark, texts)
    for t, g in zip(texts, got):
        want = brute_score(t, PHRASE_LEX, PHRASE_MODS, PHRASE_IDIOMS)
        assert g == pytest.approx(want, abs=1e-9), t


def test_what_phrases_mean(spark):
    texts = ["not half bad", "half bad", "kiss of death", "very kiss of death", "good",
             "not in the least good", "never ever in my life good", "\U0001F600", "x \u2639!"]
    comp = dict(zip(texts, (s[3] for s in _phrase_scores(spark, texts))))
    assert comp["not half bad"] > 0 > comp["half bad"]
    assert comp["very kiss of death"] < comp["kiss of death"] < 0
    assert comp["not in the least good"] < 0 < comp["good"] < comp["never ever in my life good"]
    assert comp["\U0001F600"] > 0 > comp["x \u2639!"]


def test_an_idiom_of_a_large_list_is_kept(spark):
    """A list cut to the words that occur keeps idioms and words of emoji."""
    words = [(f"w{i}", 1.0) for i in range(500)] + [("kiss of death", -1.5), ("grinning", 2.0)]
    lex = spark.createDataFrame(words, "token string, valence double")
    df = spark.createDataFrame([("a kiss of death",), ("w3 \U0001F600",), ("w9",)], "body string")
    mods = modifiers_frame(spark, PHRASE_MODS)
    want = score_text(df, lex, mods).collect()
    assert sorted(score_text(df, lex, mods, max_words=50).collect()) == sorted(want)
    assert {r.vaderScore < 0 for r in want if "kiss" in r.body} == {True}
