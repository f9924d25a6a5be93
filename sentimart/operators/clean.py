"""Projection, filtering and renaming of raw posts (the cleaning step).

``clean_posts`` is the composition used by every job: project the six
relevant fields (two through the array of matching rules), keep one
language, drop rows with any null, derive the date and turn the rule arrays
into display strings (``[a, b]``). The movie column then comes from the
rule ``tag`` ("chicago" folders) or the rule ``value`` ("gnip" folders).
All steps are plain projections and filters, so Catalyst pushes the
language filter and the nested column pruning into the JSON/Parquet scan.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.functions.dates import posted_date

RELEVANT = ["body", "tag", "value", "postedTime", "retweetCount", "twitter_lang"]
KINDS = ("chicago", "gnip")


def kind_from_path(path: str) -> str:
    """Folder kind from its path: ``gnip`` is tested first, then ``chicago``."""
    if "gnip" in path:
        return "gnip"
    if "chicago" in path:
        return "chicago"
    raise ValueError(f"cannot tell the folder kind (gnip or chicago) from {path!r}")


def select_relevant(raw: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Body, rule tags and values (array<string>), time, retweets, language
    (+ ``extra`` pass-through columns such as ``folder``)."""
    return raw.select(*(extra or []),
        "body",
        F.col("gnip.matching_rules.tag").alias("tag"),
        F.col("gnip.matching_rules.value").alias("value"),
        "postedTime",
        "retweetCount",
        "twitter_lang",
    )


def select_minimal(raw: DataFrame) -> DataFrame:
    """Body, time and retweets, rows with a null dropped."""
    return raw.select("body", "postedTime", "retweetCount").na.drop("any")


def text_only(raw: DataFrame, text_col: str = "body") -> DataFrame:
    """The text column alone, nulls dropped."""
    return raw.select(text_col).na.drop("any")


def filter_lang(df: DataFrame, lang: str = "en", lang_col: str = "twitter_lang") -> DataFrame:
    """P4."""
    return df.filter(F.col(lang_col) == F.lit(lang))


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """P5: drop a row when any listed column is null (NaN counts as null)."""
    return df.na.drop("any", subset=subset)


def rules_to_string(arr: Column) -> Column:
    """``array<string>`` to its display string ``[a, b]``."""
    return arr.cast("string")


def first_rule(arr: Column) -> Column:
    """First element or NULL (no error on an empty array)."""
    return F.try_element_at(arr, F.lit(1))


def rename_for_kind(df: DataFrame, kind: str) -> DataFrame:
    """P10: which rule field names the movie."""
    if kind == "gnip":
        return df.withColumnRenamed("value", "movieName")
    if kind == "chicago":
        return (df.withColumnRenamed("tag", "movieName")
                  .withColumnRenamed("value", "searchPattern"))
    raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")


FATE = "_fate"


def fate(raw: DataFrame, lang: str = "en") -> Column:
    """What becomes of a raw post in the cleaning, the first that holds:
    ``malformed`` (a line that is no post, kept aside by the reader),
    ``language``, ``nulls`` or ``kept``."""
    from sentimart.schema import CORRUPT_COLUMN

    bad = F.col(CORRUPT_COLUMN).isNotNull() if CORRUPT_COLUMN in raw.columns else F.lit(False)
    fields = [F.col("body"), F.col("gnip.matching_rules"), F.col("postedTime"),
              F.col("retweetCount")]
    missing = reduce(or_, [c.isNull() for c in fields])
    return (F.when(bad, "malformed")
             .when(~F.col("twitter_lang").eqNullSafe(F.lit(lang)), "language")
             .when(missing, "nulls").otherwise("kept"))


def clean_posts(raw: DataFrame, kind: str = "chicago", lang: str = "en",
                keep_arrays: bool = False, extra: list[str] | None = None,
                mark: bool = False) -> DataFrame:
    """The cleaning composition.

    Output columns (chicago): body, movieName, searchPattern, postedTime,
    retweetCount, twitter_lang, date; (gnip): body, tag, movieName, ...
    ``keep_arrays`` keeps the rule tags / values as arrays in ``tags`` /
    ``values`` beside the strings (needed for exact-name matching).
    ``mark`` drops no row: a column ``_fate`` says what would have become of
    it, and rows that would go have no text, no movie and no date.
    """
    if mark:
        gone = raw.withColumn(FATE, fate(raw, lang))
        df = select_relevant(gone, [*(extra or []), FATE])
        kept = F.col(FATE) == "kept"
        df = df.withColumns({c: F.when(kept, F.col(c)) for c in RELEVANT})
    else:
        df = drop_nulls(filter_lang(select_relevant(raw, extra), lang), RELEVANT)
    df = df.withColumn("date", posted_date(F.col("postedTime")))
    if keep_arrays:
        df = df.withColumn("tags", F.col("tag")).withColumn("values", F.col("value"))
    df = (df.withColumn("tag", rules_to_string(F.col("tag")))
            .withColumn("value", rules_to_string(F.col("value"))))
    return rename_for_kind(df, kind)
