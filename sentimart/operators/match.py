"""Movie names: discovery, matching posts to movies, chunking.

A post's movie column is the display string of its rule list, e.g. ``[a]``
or ``[a, b]``. A movie *name* selects posts whose string matches
``LIKE '%name%'`` -- substring semantics: ``src1`` also selects ``src10``,
and a post tagged with two movies counts under both.

Matching all posts against all names is a theta join. Instead of a nested
loop (posts x names), ``match_names`` works on the DISTINCT movie strings
(small: one per rule combination, not per post) and uses an exact n-gram
index: every string emits its substrings of length 0..k, counted once over
all strings; every name is keyed by the RAREST of the literal k-character
pieces of its pattern, and the real predicate confirms each candidate. A LIKE
match implies that every literal piece occurs in the string, so no match is
lost, and a piece that many strings share (a common prefix or suffix) is a
key only for names that have nothing rarer. Names with a run shorter than k
are keyed by the whole run and met by the shorter grams.

A name of several runs (``a%b``) whose rarest piece is still common is keyed by
a PAIR of pieces of two runs, in their order, the rarest two. Strings emit the
pairs of pieces that such names need and that they hold one behind the other,
so a candidate has both: the intersection of the two posting lists, without
reading either list once per name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentimart.schema import CHUNK_SIZE

MATCH_MODES = ("like", "contains", "exact")
GRAM = 6
PAIR_ABOVE = 16    # names whose rarest piece is in more strings than this are keyed by pairs


def strip_markup(s: Column) -> Column:
    """``[name]`` -> ``name``."""
    return F.substring(s, F.lit(2), F.length(s) - F.lit(2))


def unique_movies(df: DataFrame, movie_key: str = "movieName") -> DataFrame:
    """Names of movies found in single-movie rule lists, as a DataFrame.

    Multi-movie strings (containing a comma) are skipped; empty rule lists
    (``[]``) give no name.
    """
    names = (df.select(F.col(movie_key).alias("m"))
               .where(~F.col("m").like("%,%"))
               .distinct()
               .select(strip_markup(F.col("m")).alias("movieName")))
    return names.where(F.length("movieName") > 0)


def distinct_tags(df: DataFrame, col: str = "movieName") -> DataFrame:
    """A7."""
    return df.select(col).distinct()


def like_pattern(name: Column) -> Column:
    return F.concat(F.lit("%"), name, F.lit("%"))


def movie_filter(df: DataFrame, identifier: str, match: str = "like",
                 movie_key: str = "movieName") -> DataFrame:
    """Posts for one movie. ``like`` keeps LIKE semantics (``%``/``_``
    in the name are wildcards); ``contains`` is a literal substring test."""
    if match == "like":
        return df.filter(F.col(movie_key).like(f"%{identifier}%"))
    if match == "contains":
        return df.filter(F.col(movie_key).contains(identifier))
    raise ValueError(f"match must be 'like' or 'contains' here, got {match!r}")


def _runs(name: Column, mode: str) -> Column:
    """Literal runs of the pattern between wildcards, in order."""
    return F.array_remove(F.split(name, r"[%_]"), "") if mode == "like" else F.array(name)


def _cut(run: Column, k: int) -> Column:
    """All k-character substrings of a run, a shorter run whole."""
    n = F.length(run)
    return F.when(n <= k, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), n - k + 1), lambda p: F.substring(run, p, F.lit(k))))


def _pieces(name: Column, mode: str, k: int) -> Column:
    """Literal pieces of the pattern: all k-character substrings of its runs
    between wildcards, shorter runs whole, ``""`` when there is no run."""
    cut = F.transform(_runs(name, mode), lambda run: _cut(run, k))
    found = F.array_remove(F.array_distinct(F.flatten(cut)), "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def _checked(name: Column) -> Column:
    """LIKE patterns know no backslash here: raise whenever one is met."""
    return F.when(F.contains(name, F.lit("\\")),
                  F.raise_error(F.concat(F.lit("backslash in a LIKE name, use match='contains': "),
                                         name)).cast("string")).otherwise(name)


def _grams(s: Column, k: int) -> Column:
    """All substrings of length 0..k of ``s`` (the empty one once)."""
    n = F.length(s)

    def take(j: int):
        return lambda p: F.substring(s, p, F.lit(j))

    per_len = [F.array(F.lit(""))]
    for j in range(1, k + 1):
        per_len.append(F.when(
            n >= j, F.transform(F.sequence(F.lit(1), n - j + 1), take(j)),
        ).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*per_len)))


def match_names(strings: DataFrame, names: DataFrame, match: str = "like",
                string_col: str = "movieName", name_col: str = "movieName",
                tags_col: str | None = None, k: int = GRAM) -> DataFrame:
    """Pairs (``string_col`` -> ``name``) for every distinct string and every
    name that selects it. ``strings`` must already be distinct.

    ``exact`` compares whole rule tags with names (needs ``tags_col``, the
    rule array): different semantics, an opt-in equi-join.
    """
    s = strings.select(F.col(string_col).alias("_str"),
                       *([F.col(tags_col).alias("_tags")] if tags_col else []))
    nm = names.select(F.col(name_col).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    if match == "exact":
        if not tags_col:
            raise ValueError("exact matching needs the rule array column (tags_col)")
        ex = s.select("_str", F.explode(F.array_distinct("_tags")).alias("_name"))
        return ex.join(nm, "_name").select(F.col("_str").alias(string_col),
                                           F.col("_name").alias("name"))
    if match not in MATCH_MODES:
        raise ValueError(f"match must be one of {MATCH_MODES}, got {match!r}")
    if match == "like":
        nm = nm.select(_checked(F.col("_name")).alias("_name"))
    cand = candidates(s, nm, match, k)
    if match == "like":
        ok = F.like(F.col("_str"), like_pattern(F.col("_name")))
    else:
        ok = F.col("_str").contains(F.col("_name"))
    # (string, name) pairs are already unique: a string's grams and pairs are
    # distinct and every name has exactly one key
    return cand.where(ok).select(F.col("_str").alias(string_col), F.col("_name").alias("name"))


def candidates(s: DataFrame, nm: DataFrame, match: str = "like", k: int = GRAM) -> DataFrame:
    """``(_str, _name)``: every pair that can match, by a key of the name."""
    grams = s.select("_str", F.explode(_grams(F.col("_str"), k)).alias("_key"))
    counts = grams.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    # a name with a piece that no string has is left with its other pieces
    # and fails the predicate
    if match == "contains":
        keyed = (nm.select("_name", F.explode(_pieces(F.col("_name"), match, k)).alias("_key"))
                   .join(counts, "_key")
                   .groupBy("_name").agg(F.min(F.struct("_n", "_key")).alias("_m"))
                   .select("_name", F.col("_m._key").alias("_key")))
        return grams.join(keyed, "_key").select("_str", "_name")
    # the rarest piece of every run; the name without one has the empty piece
    runs = nm.select("_name", F.posexplode(F.when(
        F.size(_runs(F.col("_name"), match)) > 0, _runs(F.col("_name"), match))
        .otherwise(F.array(F.lit("")))).alias("_at", "_run"))
    piece = (runs.select("_name", "_at", F.explode(_cut(F.col("_run"), k)).alias("_key"))
                 .join(counts, "_key")
                 .groupBy("_name", "_at").agg(F.min(F.struct("_n", "_key")).alias("_m"))
                 .select("_name", F.struct("_m._n", "_m._key", "_at").alias("_p")))
    keyed = piece.groupBy("_name").agg(F.min("_p").alias("_first"), F.count("_p").alias("_runs"))
    # at most one piece per run of the name
    second = (piece.join(keyed.where((F.col("_runs") > 1) & (F.col("_first._n") > PAIR_ABOVE)), "_name")
                   .where(F.col("_p._at") != F.col("_first._at"))
                   .groupBy("_name").agg(F.min("_p").alias("_second")))
    keyed = keyed.join(second, "_name", "left")
    single = (keyed.where(F.col("_second").isNull())
                   .select("_name", F.col("_first._key").alias("_key")))
    ahead = F.col("_first._at") < F.col("_second._at")
    paired = keyed.where(F.col("_second").isNotNull()).select(
        "_name", F.when(ahead, F.col("_first._key")).otherwise(F.col("_second._key")).alias("_a"),
        F.when(ahead, F.col("_second._key")).otherwise(F.col("_first._key")).alias("_b"))
    one = grams.join(single, "_key").select("_str", "_name")
    return one.unionByName(_pairs(grams, paired).join(paired, ["_a", "_b"]).select("_str", "_name"))


def _pairs(grams: DataFrame, paired: DataFrame) -> DataFrame:
    """``(_str, _a, _b)``: pairs of pieces needed by names that a string holds
    one behind the other. The pieces of a string are its own substrings."""
    needed = paired.select(F.explode(F.array("_a", "_b")).alias("_key")).distinct()
    held = grams.join(needed, "_key")
    text, key = F.col("_str"), F.col("_key")
    starts = F.instr(text, key)
    ends = F.length(text) - F.instr(F.reverse(text), F.reverse(key)) + 2 - F.length(key)  # last start
    spot = F.struct(key.alias("key"), starts.alias("first"), ends.alias("last"))
    per = held.groupBy("_str").agg(F.collect_list(spot).alias("_h"))
    couples = F.flatten(F.transform("_h", lambda x: F.transform(
        F.filter("_h", lambda y: x.first + F.length(x.key) <= y.last),
        lambda y: F.struct(x.key.alias("_a"), y.key.alias("_b")))))
    wanted = paired.select("_a", "_b").distinct()
    return per.select("_str", F.inline(couples)).join(wanted, ["_a", "_b"], "left_semi")


def ordered_row_number(df: DataFrame, order_col: str, out_col: str = "rn",
                       partitions: int | None = None) -> DataFrame:
    """Global 1-based row number by ``order_col`` without a single-task window.

    Range-partition and sort within partitions, count rows per partition,
    turn the counts (one row per partition) into offsets, add the offset to
    the row number inside each partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, F.col(order_col))
                .sortWithinPartitions(order_col)
                .withColumn("_pid", F.spark_partition_id()))
    local = ranged.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col)))
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn(out_col, F.col("_off") + F.col("_rn"))
                 .drop("_pid", "_rn", "_off"))


def movie_chunks(names: DataFrame, chunk_size: int = CHUNK_SIZE,
                 name_col: str = "movieName") -> DataFrame:
    """``(movieName, chunkId)``, names in order, ``chunk_size`` per chunk.

    The broadcast offsets table has one row per partition, so its size is
    bounded by the partition count, not by the data.
    """
    numbered = ordered_row_number(names.select(name_col).distinct(), name_col, "_rank")
    return numbered.select(
        name_col, F.floor((F.col("_rank") - 1) / chunk_size).cast("int").alias("chunkId"))
