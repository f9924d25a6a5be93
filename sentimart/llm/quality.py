"""Quality rules (operator 8): a threshold table compiled into one projection.

``RULES`` is the table: a metric, a lower and an upper bound. ``measure``
computes the counts of a text with built-in functions only; ``verdict``
compiles the table to one boolean expression. No user function, no shuffle.

Defined cases: a null text has no words and fails; repeated rows are judged
alike; an empty table gives an empty result; further columns are ignored
(``judge``) or kept (``keep_good``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.llm.common import ROW, SPACE_CHARS, WORD, words

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Very frequent function words of English, German, French and
# Spanish.
STOP_WORDS = (
    "a and as at be by for from in is it of on that the this to was with "
    "aber als auch auf das der die ein eine für ist mit nicht sich und von zu "
    "à au ce dans de des du en est et la le les par pour qui que sur un une "
    "al como con del el es las lo los más no para por se su y"
).split()

# The threshold table: metric, least, most (None: no bound).
RULES: list[tuple[str, float | None, float | None]] = [
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.10),
    ("stop_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.50),
    ("shout_ratio", None, 0.50),
]


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, the counts and the ratios of every row's text."""
    keep = list(keep or [])
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    parts = docs.select(*keep, t.alias("_x_t"), words(F.col(text).cast("string")).alias("_x_w"))
    n = F.size("_x_w")
    hashed = parts.select("*", F.transform("_x_w", lambda w: F.xxhash64(w)).alias("_x_h"))
    # three-word windows, sorted so that equal ones are neighbours
    window = F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get("_x_h", i), F.get("_x_h", i + 1),
                                      F.get("_x_h", i + 2)).alias("g"), i.alias("p"))))
    sorted_ = hashed.select(
        *keep, "_x_t", "_x_w",
        F.sort_array(F.coalesce(window, F.array().cast("array<struct<g:bigint,p:int>>")))
         .alias("_x_s"))
    s = F.col("_x_s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"])
                     | (F.get(s, j + 1)["g"] == x["g"]))
    lines = F.filter(F.split("_x_t", "\n"), lambda x: x.rlike(WORD))
    counted = sorted_.select(
        *keep, "_x_t",
        F.size("_x_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_x_t", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.char_length("_x_t") - F.char_length(F.translate("_x_t", SYMBOLS, "")))
        .cast("long").alias("n_symbols"),
        F.transform(twice, lambda x: x["p"]).alias("_x_p"),
        lines.alias("_x_l"),
        F.size(F.filter("_x_w", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_x_stop"),
        F.size(F.filter("_x_w", lambda w: w.endswith("!"))).alias("_x_shout"))
    p = F.col("_x_p")
    covered = F.size(F.array_distinct(F.concat(
        p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2))))
    counts = F.struct(
        "n_words", "word_chars", "n_symbols",
        (F.size("_x_l") - F.size(F.array_distinct("_x_l"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_x_l").alias("_x_lines"), "_x_stop", "_x_shout")
    # One row in, one row out: a filter on the counts stays above the
    # generator. Pushed below, it would copy the measuring expressions into
    # each other, to be evaluated once per word instead of once per text.
    done = counted.select(*keep, F.inline(F.array(counts)))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return done.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("_x_stop", "n_words").alias("stop_ratio"),
        ratio("n_dup_lines", "_x_lines").alias("dup_line_ratio"),
        ratio("_x_shout", "n_words").alias("shout_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"))


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def verdict(rules: list[tuple[str, float | None, float | None]] | None = None) -> Column:
    """True when every metric of the table lies within its bounds."""
    ok = F.lit(True)
    for metric, least, most in RULES if rules is None else rules:
        if least is not None:
            ok = ok & (F.col(metric) >= F.lit(float(least)))
        if most is not None:
            ok = ok & (F.col(metric) <= F.lit(float(most)))
    return ok


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text",
          rules: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """Counts, ratios, ``base_failed`` and ``kept`` per row."""
    m = measure(docs, text, keep)
    return m.withColumn("base_failed", base_failed()) \
            .withColumn("kept", ~base_failed() & verdict(rules))


def keep_good(docs: DataFrame,
              rules: list[tuple[str, float | None, float | None]] | None = None) -> DataFrame:
    """The rows that the rules keep, all columns as they were."""
    rows = docs.select(F.struct("*").alias(ROW), F.col("text").alias("_x_text"))
    good = judge(rows, [ROW], "_x_text", rules).where("kept")
    return good.select(f"{ROW}.*")
