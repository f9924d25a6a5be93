"""Registered queries of the corpus operators, with DuckDB SQL where SQL can
express the result. Each is thin: it calls its operator over the whole table
and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart.llm import (bpe, conversations, embed, lm, mixing, quality, sharding, simhash,
                           spelling, substring, tokens, toxicity, urls)
from sentimart.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@register("op1_simhash")
def op1_simhash(spark, sf):
    r = simhash.simhash_components(table(spark, sf, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id")


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    metric = {"mean_word_chars": "word_chars / n_words", "symbol_ratio": "n_symbols / n_words",
              "stop_ratio": "n_stop / n_words", "shout_ratio": "n_shout / n_words",
              "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    rules = " AND ".join(
        f"{metric[m]} {op} {bound}" for m, least, most in quality.RULES
        for op, bound in ((">=", least), ("<=", most)) if bound is not None)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1)
  GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
         len(list_filter(w, lambda x: x LIKE '%!')) AS n_shout
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE {rules} END AS kept
FROM b"""


@register("op8_quality", _quality_sql())
def op8_quality(spark, sf):
    r = quality.judge(table(spark, sf, "documents"), ["doc_id"])
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept")


def _ranks(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.share_ranks(spark, path), public_tokenizers.PATTERN


@register("op2_sharding")
def op2_sharding(spark, sf):
    r = sharding.shard(table(spark, sf, "documents"))
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@register("op3_token_counts")
def op3_token_counts(spark, sf):
    """Three edits a document, derived from it: a deletion in the first
    third, an insertion in the middle, a replacement near the end."""
    n = F.col("n")
    edits = F.array(
        F.struct((n / 3).cast("int").alias("pos"), F.lit(9).alias("n_del"), F.lit("").alias("ins")),
        F.struct((n / 2).cast("int").alias("pos"), F.lit(0).alias("n_del"),
                 F.concat(F.lit(" (rev. "), F.col("doc_id").cast("string"),
                          F.lit(")\n\nIt's 2024  now")).alias("ins")),
        F.struct((n - 12).alias("pos"), F.lit(3).alias("n_del"), F.lit("é’ll").alias("ins")))
    docs = (table(spark, sf, "documents")
            .select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
            .select("doc_id", "text", edits.alias("edits")))
    r = tokens.count_after_edits(docs, *_ranks(spark))
    return r.select("doc_id", F.lit(3).cast("long").alias("n_edits"),
                    F.col("counts.tokens_before").alias("tokens_before"),
                    F.col("counts.tokens_after").alias("tokens_after"),
                    F.col("counts.chars_recut").alias("chars_recut"))


_MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0 * source_size::DOUBLE AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][
           CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w
  FROM s),
o AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM w),
l AS (SELECT max(CASE WHEN (total - full_) / open_ * w <= cap THEN (total - full_) / open_ END) AS level
      FROM o),
t AS (SELECT source, source_size, coalesce(least(cap, level * w), cap) AS target FROM w, l),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
            (budget // source_size) * size
            + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END
            AS BIGINT) AS taken
FROM p"""


@register("op4_mixing", _MIX_SQL)
def op4_mixing(spark, sf):
    r = mixing.mix(table(spark, sf, "documents"))
    return r.select("doc_id", "size", "source_size", "target", "taken")


@register("op5_bpe")
def op5_bpe(spark, sf):
    ranks, pattern = _ranks(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    back = bpe.encode_decode(docs, ranks, pattern)
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op6_urls", r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM r""")
def op6_urls(spark, sf):
    return urls.judge(table(spark, sf, "pages"))


@register("op7_substring")
def op7_substring(spark, sf):
    r = substring.dedup_spans(table(spark, sf, "documents"))
    return r.select("doc_id", "text", F.col("_x_removed").alias("n_removed"))


@register("op9_lm_score")
def op9_lm_score(spark, sf):
    return lm.score(table(spark, sf, "documents"), *_ranks(spark))


@register("op10_embeddings")
def op10_embeddings(spark, sf):
    return embed.near_duplicates(table(spark, sf, "embeddings"))


@register("op11_spelling")
def op11_spelling(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@register("op12_toxicity")
def op12_toxicity(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op13_conversations")
def op13_conversations(spark, sf):
    damaged = conversations.damage(table(spark, sf, "conversations"))
    return conversations.repair(damaged, F.col("gone"))
