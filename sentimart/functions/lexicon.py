"""Lexicon and modifier tables for the scorer.

The scorer is driven by two small tables, so a user can load any word list:

* ``lexicon(token string, valence double)`` -- lower-case tokens, valence on
  a -4..4 scale. A token of several words is an idiom, scored as one.
* ``modifiers(token string, kind string, scalar double)`` -- ``kind`` is
  ``booster`` (scalar is added towards the valence's sign), ``negation``,
  ``negation_near`` (negates the next token only), ``amplifier`` (multiplies
  by scalar) or ``emoji`` (a sign and, after a blank, the words it is read as).
  A booster or amplifier of several words ("kind of") stands for all in a row.

The seed list is a starter set built from a rule: common words in groups of
four strengths (``SEED_GROUPS``), every word of a group with the group's
strength. Scores computed with it are not comparable to any published word
list. Load a full list with ``load_lexicon`` for real use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXICON_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("valence", T.DoubleType(), False),
])
MODIFIER_SCHEMA = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("scalar", T.DoubleType(), False),
])


@dataclass(frozen=True)
class ScorerParams:
    """Constants of the rule-based scorer (Hutto & Gilbert, ICWSM 2014).

    Fixed values: these are the method's usual defaults as we recall them;
    they could not be checked offline, so they live here in one place.
    """

    caps_increment: float = 0.733        # all-caps lexicon word, others not
    negation_scalar: float = -0.74       # per negation among 3 preceding tokens
    damp_distance_2: float = 0.95        # booster two tokens back
    damp_distance_3: float = 0.9         # booster three tokens back
    but_before: float = 0.5              # valences before the first "but"
    but_after: float = 1.5               # valences after it
    exclaim_increment: float = 0.292     # per "!", at most exclaim_max
    exclaim_max: int = 4
    question_increment: float = 0.18     # per "?" when there are 2 or 3
    question_max_emphasis: float = 0.96  # when there are more than 3
    alpha: float = 15.0                  # compound = s / sqrt(s^2 + alpha)
    but_token: str = "but"
    negation_suffix: str = "n't"


DEFAULT_PARAMS = ScorerParams()

BOOSTER = 0.293      # fixed value of the method
NEVER_SO = 1.25      # fixed value of the method

# Strength of each group of the seed list, by hand: mild, clear, strong and
# extreme, the same for both signs.
SEED_STRENGTHS = {"mild": 1.0, "clear": 2.0, "strong": 3.0, "extreme": 4.0}

# Seed words by sign and strength. Words were put into a group by hand; no
# word has a value of its own.
SEED_GROUPS: dict[tuple[int, str], str] = {
    (1, "mild"): "ok okay fine decent worth cool fresh neat :p",
    (1, "clear"): "good nice fun funny like liked glad enjoy enjoyed smart better thanks hope :)",
    (1, "strong"): "great love loved happy excellent beautiful exciting impressive win :d <3",
    (1, "extreme"): "amazing awesome best brilliant fantastic masterpiece perfect wonderful",
    (-1, "mild"): "meh slow weak overrated bored odd :/",
    (-1, "clear"): "bad boring dull lame poor sad wrong mess annoying problem sorry :(",
    (-1, "strong"): "angry awful disappointed hate hated fail failed stupid ugly waste trash",
    (-1, "extreme"): "disgusting garbage horrible pathetic terrible worst worthless",
}


def seed_lexicon_rows() -> list[tuple[str, float]]:
    return [(w, sign * SEED_STRENGTHS[name]) for (sign, name), words in SEED_GROUPS.items()
            for w in words.split()]


SEED_LEXICON: list[tuple[str, float]] = seed_lexicon_rows()

# Seed modifiers: common English degree words, negations and the idioms that
# the method names.
SEED_BOOSTERS_UP = [
    "absolutely", "completely", "extremely", "highly", "incredibly", "really", "so", "super",
    "totally", "truly", "very",
]
SEED_BOOSTERS_DOWN = [
    "barely", "hardly", "kind of", "kinda", "less", "partly", "slightly", "somewhat", "sort of",
    "sorta",
]
SEED_NEGATIONS = [
    "cannot", "cant", "didnt", "doesnt", "dont", "isnt", "neither", "never", "nobody", "none",
    "nor", "not", "nothing", "wasnt", "without", "wont",
]
SEED_IDIOMS = [
    ("least", "negation_near", 0.0), ("at least", "amplifier", 1.0),
    ("very least", "amplifier", 1.0), ("never so", "amplifier", NEVER_SO),
    ("never this", "amplifier", NEVER_SO),
]


def seed_modifier_rows() -> list[tuple[str, str, float]]:
    rows = [(w, "booster", BOOSTER) for w in SEED_BOOSTERS_UP]
    rows += [(w, "booster", -BOOSTER) for w in SEED_BOOSTERS_DOWN]
    rows += [(w, "negation", 0.0) for w in SEED_NEGATIONS]
    return rows + SEED_IDIOMS


def _sql_literal(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) + "D" if isinstance(v, float) else str(v)


def _inline(spark: SparkSession, schema: T.StructType, rows: list[tuple]) -> DataFrame:
    """Small literal table as one SQL ``VALUES`` relation (a local relation in
    the JVM: no Python RDD behind it, one call to build)."""
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f.name for f in schema.fields)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def lexicon_frame(spark: SparkSession, rows: list[tuple[str, float]] | None = None) -> DataFrame:
    """Lexicon as a DataFrame (seed list by default)."""
    rows = SEED_LEXICON if rows is None else rows
    return _inline(spark, LEXICON_SCHEMA, [(t.lower(), float(v)) for t, v in rows])


def modifiers_frame(spark: SparkSession,
                    rows: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Modifiers as a DataFrame (seed list by default)."""
    rows = seed_modifier_rows() if rows is None else rows
    return _inline(spark, MODIFIER_SCHEMA, [(t.lower(), k, float(s)) for t, k, s in rows])


def _read_columns(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Fields of a plain separated file: no quoting and no escaping, so a
    token may start with a quotation mark or hold a backslash."""
    return (spark.read.option("sep", sep).option("header", "false").option("quote", "")
            .option("escape", "").option("comment", "").csv(path))


def load_lexicon(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Load a word list file: token, valence, then any further columns.

    The common distribution format is tab separated without header
    (token, mean valence, standard deviation, raw ratings); only the first
    two columns are used. Tokens that are equal in lower case are one entry
    with the mean of their valences (rounded to 4 decimals, summed exactly).
    """
    raw = _read_columns(spark, path, sep)
    valence = F.col("_c1").try_cast("decimal(20,8)")
    mean = F.round(F.sum(valence) / F.count(valence), 4).cast("double")
    return (raw.where(F.col("_c0").isNotNull() & valence.isNotNull())
               .groupBy(F.lower(F.col("_c0")).alias("token")).agg(mean.alias("valence")))


MODIFIER_KINDS = ("booster", "negation", "negation_near", "amplifier", "emoji")


def load_modifiers(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Load modifiers: token, kind (one of ``MODIFIER_KINDS``), scalar."""
    raw = _read_columns(spark, path, sep)
    return (raw.select(F.lower(F.col("_c0")).alias("token"),
                       F.lower(F.col("_c1")).alias("kind"),
                       F.coalesce(F.col("_c2").try_cast("double"), F.lit(0.0)).alias("scalar"))
               .where(F.col("token").isNotNull() & F.col("kind").isin(*MODIFIER_KINDS)))
