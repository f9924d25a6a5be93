"""Corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing
to source weights, byte-level BPE.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared checkpoint folder and hands the
reread table to the next stage. All stages but the last return the columns
of ``documents``; the mix repeats a document's row for every pass of its
source, and the last stage returns the token ids with what a trainer needs
beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart.llm import bpe, mixing, quality, simhash, substring
from sentimart.llm.common import save, table

VOCABULARY = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id."""
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the text of all documents but the first;
    ``n_chars`` follows the text, and documents left without a word go."""
    cut = substring.dedup_spans(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_x_removed") > 0, F.char_length("text"))
                             .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    gone = (F.col("_x_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(gone, F.lit(False))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them."""
    return mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, decoded again as a check of the round trip."""
    import public_tokenizers

    ranks = bpe.share_ranks(spark, public_tokenizers.path(VOCABULARY))
    back = bpe.encode_decode(docs.select("doc_id", "source", "lang", "text"), ranks,
                             public_tokenizers.PATTERN)
    return back.select("doc_id", "source", "lang",
                       F.size("token_ids").cast("long").alias("n_tokens"), "token_ids",
                       (F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
                       .alias("round_trip"))


STAGES = [("quality rules", quality_rules),
          ("SimHash near-dedup", simhash_near_dedup),
          ("substring dedup", substring_dedup),
          ("mixing sources to target weights", mix_sources),
          ("byte-level BPE", byte_bpe)]

# the near-duplicate stages follow links, which SQL does not express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
