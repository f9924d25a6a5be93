"""URL filters by a Bloom filter cascade (operator 6).

Rules are (host, path) keys. A rule fits a url if its host is the url's host
or a parent domain and the url's path starts with the rule's path, so the
keys that could fit a url are its host's suffixes of the label counts that
rules have, combined with the path's prefixes of the lengths that rules have.
The set of these over all urls is the corpus's complete key universe; a url
gives as many keys at most, however long its host is. The rules may be a table
of any size: the driver sees only the distinct counts and lengths.

The cascade encodes, for that universe, exactly which keys are listed:
level 1 is a Bloom filter of the listed keys; level 2 one of the universe's
false positives at level 1; level 3 one of the listed keys that pass level
2, and so on, until a level passes nothing wrong. A key's answer is the
parity of the first level that rejects it: exact for every key of the
universe, and the urls never meet the list in a join. Level 1's rate follows
the ratio of listed keys to the universe, so all levels together need some
bits per listed key and level; they are literals of one projection and
``MAX_BITS_TOTAL`` bounds them.

Each action has a cascade of its own; the longest listed key wins (longer
host, then longer path).

Columns: ``page_id`` and ``url``; others are ignored. Defined cases: a null
url or one without ``://`` has empty host and path and no rule; urls without
a rule get the method's verdict, ``allow``, as they are not listed; repeated
rows are judged alike; an empty table or an empty rule list works.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart.llm.common import save

# Fixed values of the contract: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
MAX_BITS_TOTAL = 1 << 26   # bound of the literals sent to the executors
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every key that could fit, longest host first, then longest path."""
    has = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = []
    for j in sorted(set(labels), reverse=True):
        suffix = F.when((host != "") & (has >= j), F.substring_index(host, ".", -j))
        for n in sorted(set(lengths), reverse=True):
            keys.append(F.concat(suffix, F.when(F.length(path) >= n, F.substring(path, 1, n))))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


@dataclass
class Level:
    """One Bloom filter: ``words`` of 32 bits, ``hashes`` per key."""
    seed: int
    bits: int
    hashes: int
    words: list[int]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(f"{self.seed}.{i}:"), key), F.lit(self.bits)).cast("int")
                for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w) for w in self.words]) if len(self.words) <= 64 else F.split(
            F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        ok = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.shiftright(p, 5)).cast("long")
            ok = ok & (F.getbit(word, p.bitwiseAND(F.lit(31))) == 1)
        return ok


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A Bloom filter of ``keys(key)`` with false-positive rate ``rate``.
    Its words are summed up on the executors; the driver gets the words."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2)))
    if bits > MAX_BITS_TOTAL:
        raise ValueError(f"a level of {bits} bits passes the bound of {MAX_BITS_TOTAL}")
    level = Level(seed, bits, hashes, [])
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    got = (at.groupBy(F.shiftright("p", 5).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                           F.col("p").bitwiseAND(F.lit(31)))).alias("v")).collect())
    level.words = [0] * (bits // 32 + 1)
    for r in got:
        level.words[r.w] = r.v
    return level


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell ``listed(key)`` from the rest of ``universe(key)``;
    both hold distinct keys."""
    n = listed.count()
    if not n:
        return []
    total = max(universe.count(), 1)
    # the rate at which the first level's false positives are about as many
    # as the listed keys; half for all further levels
    rate = min(0.5, n / (math.sqrt(2) * total))
    inside, outside, count, levels = listed, universe.join(listed, "key", "left_anti"), n, []
    while count:
        level = build_level(inside, count, rate, len(levels) + 1)
        levels.append(level)
        wrong = save(outside.where(level.passes(F.col("key"))), "cascade")
        inside, outside, count, rate = wrong, inside, wrong.count(), 0.5
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """True if the cascade says that ``key`` is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[k].passes(key), F.lit(k % 2 == 1)).otherwise(answer)
    return answer


def rule_table(spark: SparkSession, rules: DataFrame | list[tuple[str, str, str]] | None) -> DataFrame:
    """``(action, host, path, key)`` of rules given as a table or a list."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(RULES if rules is None else rules,
                                      "action string, host string, path string")
    return (rules.select("action", "host", "path").where(
        F.col("action").isNotNull() & F.col("host").isNotNull() & F.col("path").isNotNull())
        .distinct().withColumn("key", F.concat("host", "path")))


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] | None = None,
          default: str = DEFAULT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row. ``rules``: a table
    ``(action, host, path)`` or a list of such rows; rows with a null are left
    out. Two actions for one key: the last in order counts."""
    spark = pages.sparkSession
    listed = rule_table(spark, rules)
    shape = listed.agg(
        F.collect_set(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1).alias("j"),
        F.collect_set(F.length("path")).alias("n"), F.collect_set("action").alias("a")).first()
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = base.select("*", candidate_keys(F.col("host"), F.col("path"), shape.j or [1],
                                            shape.n or [1]).alias("keys"))
    universe = save(keyed.select(F.explode("keys").alias("key")).distinct(), "universe")
    listed_as = {action: build_cascade(listed.where(F.col("action") == action).select("key").distinct(),
                                       universe) for action in sorted(shape.a)}
    first = F.lit(None).cast("struct<rule:string,verdict:string>")

    def look(key: Column) -> Column:
        found = F.lit(None).cast("string")
        for action, levels in listed_as.items():
            if levels:
                found = F.when(member(levels, key), F.lit(action)).otherwise(found)
        return F.struct(key.alias("rule"), found.alias("verdict"))

    hits = F.filter(F.transform("keys", look), lambda x: x["verdict"].isNotNull())
    return (keyed.select("page_id", "host", "path", F.coalesce(F.get(hits, F.lit(0)), first)
                         .alias("hit"))
                 .select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce("hit.verdict", F.lit(default)).alias("verdict")))
