"""Posts derived from the driver's ``documents`` table (test and bench input).

The original job reads JSON post dumps that are not available here, so the
registered queries read ``documents`` and derive the post fields from it
with plain Spark expressions (the DuckDB oracle applies the same rules in
SQL). Every document becomes one post; the text is used whole.

Rules (first matching line wins for the rules list):

    body          = text
    twitter_lang  = lang
    retweetCount  = doc_id % 7
    postedTime    = 2024-01-01 + (floor(doc_id / 20) % 30) days, 'YYYY-MM-DDT12:00:00.000Z'
    matching_rules: doc_id % 97 = 0 -> gnip NULL (row dropped by the null drop)
                    doc_id % 89 = 0 -> empty rule list
                    doc_id % 7  = 0 -> two rules: source, 'src' || ((doc_id + 1) % 20)
                    otherwise       -> one rule: source
                    each rule: tag = name, value = 'q ' || name
    folder        = 'chicago_' || (doc_id % 3)   (multi-folder jobs)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart.schema import RULES_TYPE

# Test lexicon for the registered queries. The generated English
# prose has none of the usual sentiment words, so frequent words get test
# valences, and the toxic-label words one of three strengths by hand (mild 1,
# clear 2, strong 3). These exist only for tests and the bench.
FIXTURE_LEXICON: list[tuple[str, float]] = [
    ("trash", -2.0), ("scum", -3.0), ("clown", -1.0), ("idiot", -3.0), ("worthless", -2.0),
    ("moron", -3.0), ("pathetic", -2.0), ("loser", -2.0), ("disgusting", -3.0), ("stupid", -2.0),
    ("the", 1.1), ("that", 0.8), ("of", -1.3), ("and", -0.7), ("to", 0.9), ("it", -1.0),
    ("for", 1.4), ("this", -1.6),
]
FIXTURE_MODIFIERS: list[tuple[str, str, float]] = [
    ("is", "booster", 0.293), ("was", "booster", 0.293),
    ("with", "negation", 0.0), ("by", "negation", 0.0), ("never", "negation", 0.0),
    ("least", "negation_near", 0.0), ("kind of", "booster", -0.293),
    ("never so", "amplifier", 1.25), ("at least", "amplifier", 1.0),
]
# Clauses appended by ``rule_bodies``, one rule each, as the
# generated prose holds no "but", no "n't", no "?" and no idiom.
RULE_CLAUSES = [" but this is it", " isn't that for", " the that??", " the that???",
                " the that?????", " IS the", " kind of the", " never so the", " least the",
                " at least the", " THE that", " was this!!"]

# Entries of several words, idioms and emoji for the key with
# phrases, and clauses that hold them.
PHRASE_LEXICON: list[tuple[str, float]] = [
    ("kiss of the clown", -1.5), ("the that", 2.2), ("is it the that", -0.9), ("cut the", 2.0),
]
PHRASE_MODIFIERS: list[tuple[str, str, float]] = [
    ("by no means", "amplifier", -0.5), ("in the end of it", "booster", 0.4),
    ("this is at least", "booster", -0.2), ("this is at least", "amplifier", 1.1),
    ("\U0001F600 that grin", "emoji", 0.0), ("\U0001F600\u200D\u2744 cold trash", "emoji", 0.0),
    ("\u2639 scum", "emoji", 0.0),
]
PHRASE_CLAUSES = [
    " by no means the", " in the end of it the", " in the end of it so the", " this is at least trash",
    " never so at least the", " kiss of the clown!", " very KISS of the clown with it", " of the that of",
    " with is it the that but cut the", " kind of cut the", " good\U0001F600bad",
    " with \U0001F600\u200D\u2744\U0001F600 the", " \u2639\u2639 by the", " by no the that means"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rule(name: Column) -> Column:
    return F.struct(name.alias("tag"), F.concat(F.lit("q "), name).alias("value"))


def posts_from_documents(docs: DataFrame, with_folder: bool = False,
                         with_id: bool = False) -> DataFrame:
    """Raw posts (POST_SCHEMA shape) from a ``documents`` DataFrame."""
    i = F.col("doc_id")
    second = F.concat(F.lit("src"), ((i + 1) % 20).cast("string"))
    rules = (F.when(i % 97 == 0, F.lit(None).cast(RULES_TYPE))
              .when(i % 89 == 0, F.array().cast(RULES_TYPE))
              .when(i % 7 == 0, F.array(_rule(F.col("source")), _rule(second)))
              .otherwise(F.array(_rule(F.col("source")))))
    gnip = F.when(rules.isNull(), F.lit(None)).otherwise(F.struct(rules.alias("matching_rules")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(i / 20) % 30).cast("int"))
    posted = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:00:00.000Z"))
    cols = [
        F.col("text").alias("body"),
        gnip.alias("gnip"),
        posted.alias("postedTime"),
        (i % 7).alias("retweetCount"),
        F.col("lang").alias("twitter_lang"),
    ]
    if with_folder:
        cols.append(F.concat(F.lit("chicago_"), (i % 3).cast("string")).alias("folder"))
    if with_id:
        cols.append(i.alias("doc_id"))
    return docs.select(*cols)


def fixture_posts(spark: SparkSession, sf_dir: str, with_folder: bool = False,
                  with_id: bool = False) -> DataFrame:
    return posts_from_documents(read_table(spark, sf_dir, "documents"), with_folder, with_id)


def rule_bodies(docs: DataFrame, clauses: list[str] = RULE_CLAUSES) -> DataFrame:
    """``(doc_id, body)``: the whole text and a clause by ``doc_id``."""
    clause = F.element_at(F.array(*[F.lit(c) for c in clauses]),
                          (F.col("doc_id") % len(clauses) + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", clause).alias("body"))


def fixture_lexicon(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    from sentimart.functions.lexicon import lexicon_frame, modifiers_frame
    return lexicon_frame(spark, FIXTURE_LEXICON), modifiers_frame(spark, FIXTURE_MODIFIERS)


def phrase_lexicon(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The test lexicon with idioms, phrases of up to five words and emoji.
    "by no means" and the like take the place of shorter entries."""
    from sentimart.functions.lexicon import lexicon_frame, modifiers_frame
    single = [m for m in FIXTURE_MODIFIERS if " " not in m[0] or m[0] == "never so"]
    return (lexicon_frame(spark, FIXTURE_LEXICON + PHRASE_LEXICON),
            modifiers_frame(spark, single + PHRASE_MODIFIERS))
