"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the driver's tables (posts derived from ``documents``; ``events`` for the
date parser). ``ORACLE`` holds the DuckDB SQL for the same result. Queries
that read files first stage the posts in a fresh folder under the shared
checkpoint folder and read them back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentimart import oracle as O
from sentimart.functions.dates import free_date, lenient_date, posted_date
from sentimart.operators import clean as C
from sentimart.operators import daily as D
from sentimart.operators.classify import classify
from sentimart.operators.match import (distinct_tags, match_names, movie_chunks, movie_filter,
                                       unique_movies)
from sentimart.operators.score import score_text, score_with
from sentimart.plans import daily as PL
from sentimart.schema import (COUNTS_SCHEMA, THRESHOLDS_4WAY, THRESHOLDS_DEFAULT, THRESHOLDS_THIRDS)
from sentimart.session import shared_dir
from sentimart.sources import posts as S
from sentimart.sources import sinks as K
from sentimart.sources.fixture import (PHRASE_CLAUSES, fixture_lexicon, fixture_posts,
                                       phrase_lexicon, read_table, rule_bodies)

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


# --- shared pieces -----------------------------------------------------------

def _posts(spark, sf, **kw):
    return fixture_posts(spark, sf, **kw)


def _clean(spark, sf, kind="chicago"):
    return C.clean_posts(_posts(spark, sf), kind=kind)


def _lex(spark):
    return fixture_lexicon(spark)


# The test tables are one file each; scoring is spread over at least this many
# tasks (an input of that many files, of any size, is left as it is).
TASKS = 8


def _scored_docs(spark, sf, all_scores=False, keep=("doc_id",)):
    lex, mods = _lex(spark)
    docs = read_table(spark, sf, "documents")
    return score_text(docs, lex, mods, text_col="text", all_scores=all_scores,
                      keep=keep and list(keep), min_partitions=TASKS)


def _classified(spark, sf, kind="chicago", thresholds=None, extra=None):
    lex, mods = _lex(spark)
    return PL.scored_posts(_posts(spark, sf, with_folder=bool(extra)), lex, mods, kind=kind,
                           thresholds=thresholds or THRESHOLDS_DEFAULT, extra_keys=extra,
                           min_partitions=TASKS)


def _daily(spark, sf, **kw):
    lex, mods = _lex(spark)
    raw = _posts(spark, sf, with_folder="keys" in kw)
    return PL.daily_sentiment(raw, lex, mods, persist=True, order=False, min_partitions=TASKS,
                              **kw)


def _joined_outputs(counts: DataFrame, stats: DataFrame, keys: list[str], n_classes: int = 3):
    """Both outputs in one table, so that one key checks both: the statistics
    and a count column per class."""
    on = [*keys, "date", "movieName"]
    wide = counts.groupBy(*on).agg(*[
        F.coalesce(F.sum(F.when(F.col("vaderClassifier") == float(k), F.col("nTweets"))), F.lit(0))
         .alias(f"nClass{k}") for k in range(n_classes)])
    return stats.join(wide, on)


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


_POSTS = f"posts AS ({O.posts_sql()})"
_CLEAN = f"clean AS ({O.clean_sql('chicago')})"
_CLS = O.classified_ctes("chicago")
_DOC_SCORES = ("docsrc AS (SELECT doc_id AS id, text FROM documents),\n"
               + O.scorer_ctes("docsrc", []))
_MOVIES = f"movies AS ({O.movies_found_sql()})"


# --- S: sources and sinks ----------------------------------------------------

_P1_SQL = "SELECT body, tag, value, postedTime, retweetCount, twitter_lang FROM posts"


def _stage_posts(spark, sf, **kw) -> str:
    path = shared_dir(spark, "posts")
    K.write_posts_json(K.evenly(_posts(spark, sf, **kw)), path)
    return path


def _p1_strings(df: DataFrame) -> DataFrame:
    r = C.select_relevant(df)
    return r.select("body", C.rules_to_string(F.col("tag")).alias("tag"),
                    C.rules_to_string(F.col("value")).alias("value"),
                    "postedTime", "retweetCount", "twitter_lang")


@register("load_tweets", _w(_POSTS) + "\n" + _P1_SQL)
def q_load_tweets(spark, sf):
    path = _stage_posts(spark, sf)
    return _p1_strings(S.read_posts(spark, path + "/"))


# A malformed line is derived from every 11th post: its JSON cut in half.
_BAD = "doc_id % 11 = 0"


def _stage_with_malformed(spark, sf) -> str:
    posts = _posts(spark, sf, with_id=True)
    line = F.to_json(F.struct(*[c for c in posts.columns if c != "doc_id"]))
    cut = F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))
    lines = posts.select(F.when(F.expr(_BAD), cut).otherwise(line).alias("value"))
    path = shared_dir(spark, "malformed")
    K.write_lines_gz(K.evenly(lines), path)
    return path


@register("load_drop_malformed",
          _w(_POSTS) + f"\nSELECT body, tag, value, postedTime, retweetCount, twitter_lang "
                       f"FROM posts WHERE NOT (id % 11 = 0)")
def q_load_drop_malformed(spark, sf):
    return _p1_strings(S.read_posts(spark, _stage_with_malformed(spark, sf) + "/"))


@register("split_malformed", """
SELECT 'bad' AS side, count(*) AS nRows FROM documents WHERE doc_id % 11 = 0
UNION ALL
SELECT 'good' AS side, count(*) AS nRows FROM documents WHERE doc_id % 11 <> 0""")
def q_split_malformed(spark, sf):
    good, bad = S.split_malformed(spark, _stage_with_malformed(spark, sf) + "/")
    g = good.select(F.lit("good").alias("side"), "body")
    b = bad.select(F.lit("bad").alias("side"),
                   F.coalesce(F.col("_corrupt_record"), F.col("body")).alias("body"))
    # count the text column (not rows) so the scan keeps a second column
    return g.unionByName(b).groupBy("side").agg(F.count("body").alias("nRows"))


# Lines of every kind of fault, by the post's id.
_FAULT = """CASE WHEN doc_id % 11 = 0 THEN 'cut off or broken' WHEN doc_id % 13 = 0 THEN 'not an object'
     WHEN doc_id % 17 = 0 THEN 'wrong type' END"""


def _stage_faults(spark, sf) -> str:
    posts = _posts(spark, sf, with_id=True, with_folder=True)
    line = F.to_json(F.struct(*[c for c in posts.columns if c not in ("doc_id", "folder")]))
    cut = F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))
    fault = F.expr(_FAULT)
    text = (F.when(fault == "cut off or broken", cut)
             .when(fault == "not an object", F.concat(F.lit("line "), F.col("doc_id").cast("string")))
             .when(fault == "wrong type", F.regexp_replace(
                 line, r'"retweetCount":\d+', '"retweetCount":{"n":1}')).otherwise(line))
    path = shared_dir(spark, "faults")
    (posts.select(text.alias("value"), "folder").write.option("compression", "gzip")
          .partitionBy("folder").text(path))
    return path


@register("quarantine", f"""
SELECT 'chicago_' || CAST(doc_id % 3 AS VARCHAR) AS folder, {_FAULT} AS reason, count(*) AS nLines
FROM documents WHERE {_FAULT} IS NOT NULL GROUP BY ALL
UNION ALL
SELECT strftime(DATE '2024-01-01' + CAST((doc_id // 20) % 30 AS INTEGER), '%Y-%m-%d') AS folder,
       'good' AS reason, count(*) AS nLines
FROM documents WHERE {_FAULT} IS NULL GROUP BY ALL""")
def q_quarantine(spark, sf):
    """Bad lines by folder and reason, good posts by day, from one scan."""
    good, bad = S.quarantine(spark, _stage_faults(spark, sf) + "/*/", shared_dir(spark, "quarantine"))
    good = good.groupBy(F.substring("postedTime", 1, 10).alias("folder")).agg(
        F.lit("good").alias("reason"), F.count("body").alias("nLines"))
    return (bad.groupBy(S.folder_of(F.col("file")).alias("folder"), "reason")
               .agg(F.count("line").alias("nLines")).unionByName(good))


@register("intake_counts", f"""
SELECT CASE WHEN doc_id % 11 = 0 THEN 'malformed' WHEN lang <> 'en' THEN 'language'
            WHEN doc_id % 97 = 0 THEN 'nulls' ELSE 'kept' END AS fate, count(*) AS nRows
FROM documents GROUP BY ALL""")
def q_intake_counts(spark, sf):
    """What became of the raw posts, counted by the daily job itself."""
    lex, mods = _lex(spark)
    raw = S.read_marked(spark, _stage_with_malformed(spark, sf) + "/")
    return PL.daily_sentiment(raw, lex, mods, order=False, min_partitions=TASKS, intake=True).intake


def _stage_folders(spark, sf) -> str:
    path = shared_dir(spark, "folders")
    K.write_posts_json(_posts(spark, sf, with_folder=True), path, partition_by=["folder"])
    return path


@register("load_many_folders", _w(_POSTS) + "\n" + _P1_SQL)
def q_load_many_folders(spark, sf):
    root = _stage_folders(spark, sf)
    return _p1_strings(S.read_posts(spark, root + "/*/", recursive=False))


@register("folder_column", _w(_POSTS) + """
SELECT folder, count(*) AS nPosts FROM posts GROUP BY folder""")
def q_folder_column(spark, sf):
    root = _stage_folders(spark, sf)
    df = S.read_folders(spark, root)
    # partitionBy writes folder=<name>; the folder name is the value part
    folder = F.regexp_replace(F.col("folder"), "^folder=", "")
    return df.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("nPosts"))


@register("empty_files", """
SELECT 'chicago_' || CAST(doc_id % 3 AS VARCHAR) AS folder,
       count(CASE WHEN doc_id % 97 = 0 THEN 1 END) AS nEmpty
FROM documents GROUP BY doc_id % 3""")
def q_empty_files(spark, sf):
    root = _stage_folders(spark, sf)
    # a zero-length file for every post that came without rules, as left
    # behind by an interrupted copy
    docs = read_table(spark, sf, "documents").where("doc_id % 97 = 0")
    K.write_empty_files(docs.select(
        F.concat(F.lit("chicago_"), (F.col("doc_id") % 3).cast("string")).alias("folder"),
        F.col("doc_id").alias("n")), root)
    return S.file_report(spark, root).select("folder", "nEmpty")


_STATS_ORACLE = _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + f"""
SELECT s.date, {O.stats_select()}, m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, m.name"""

_COUNTS_ORACLE = _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + """
SELECT s.date, s.vaderClassifier, count(*) AS nTweets, m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, s.vaderClassifier, m.name"""


_JOINED_COLUMNS = """count(CASE WHEN s.vaderClassifier = 0.0 THEN 1 END) AS nClass0,
       count(CASE WHEN s.vaderClassifier = 1.0 THEN 1 END) AS nClass1,
       count(CASE WHEN s.vaderClassifier = 2.0 THEN 1 END) AS nClass2"""

_BOTH_ORACLE = _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + f"""
SELECT s.date, {O.stats_select()}, m.name AS movieName, {_JOINED_COLUMNS}
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, m.name"""


@register("write_csv_roundtrip", _BOTH_ORACLE)
def q_write_csv_roundtrip(spark, sf):
    out = _daily(spark, sf)
    root = shared_dir(spark, "csv")
    K.write_daily(out.counts, out.stats, root)
    return _joined_outputs(K.read_counts(spark, f"{root}/counts/daily"),
                           K.read_stats(spark, f"{root}/stats/daily"), [])


# names that a careless writer or reader would change, and two named folders
_ODD = [" lead", "trail ", "line\nbreak", "cr\r\nlf", 'quo"te', "com,ma", "back\\slash", ""]
_ODD_SQL = "[" + ", ".join(
    "'" + n.replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'" for n in _ODD) + "]"


@register("named_files_roundtrip", f"""
SELECT 'set ' || CAST(doc_id % 3 AS VARCHAR) AS folder, DATE '2024-01-01' AS date,
       CAST(doc_id % 2 AS DOUBLE) AS vaderClassifier, count(*) AS nTweets,
       CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 8 = 7 THEN ''
            ELSE source || ({_ODD_SQL})[CAST(doc_id % 8 AS INTEGER) + 1] END AS movieName
FROM documents GROUP BY ALL""")
def q_named_files_roundtrip(spark, sf):
    """One CSV file per folder, written by two runs and a repeated one."""
    i = F.col("doc_id")
    odd = F.element_at(F.array(*map(F.lit, _ODD)), (i % 8 + 1).cast("int"))
    name = (F.when(i % 5 == 4, F.lit(None)).when(i % 8 == 7, "")
             .otherwise(F.concat("source", odd)))
    counts = (read_table(spark, sf, "documents")
              .select(F.lit("2024-01-01").cast("date").alias("date"),
                      (i % 2).cast("double").alias("vaderClassifier"), name.alias("movieName"),
                      F.concat(F.lit("set "), (i % 3).cast("string")).alias("folder"))
              .groupBy("date", "vaderClassifier", "movieName", "folder")
              .agg(F.count(F.lit(1)).alias("nTweets"))
              .select("date", "vaderClassifier", "nTweets", "movieName", "folder"))
    root = shared_dir(spark, "named")
    for part in ("folder <> 'set 1'", "folder = 'set 1'", "folder = 'set 0'"):
        K.write_named_csv(counts.where(part), root, "folder", ["movieName"])
    return K.read_named_csv(spark, root, COUNTS_SCHEMA, "folder")


_CHUNKS_ORACLE = _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + """
SELECT name AS movieName,
       CAST(floor((row_number() OVER (ORDER BY name) - 1) / 10) AS INTEGER) AS chunkId
FROM movies"""


@register("movie_list_roundtrip", _CHUNKS_ORACLE)
def q_movie_list_roundtrip(spark, sf):
    chunks = movie_chunks(unique_movies(_clean(spark, sf)))
    path = shared_dir(spark, "movielist")
    K.save_movie_list(chunks, path)
    return K.load_movie_list(spark, path)


# --- P: projections, filters, casts -----------------------------------------

@register("select_relevant", _w(_POSTS) + "\n" + _P1_SQL)
def q_select_relevant(spark, sf):
    return _p1_strings(_posts(spark, sf))


@register("select_minimal", _w(_POSTS) + "\nSELECT body, postedTime, retweetCount FROM posts")
def q_select_minimal(spark, sf):
    return C.select_minimal(_posts(spark, sf))


@register("text_only", _w(_POSTS) + "\nSELECT body FROM posts")
def q_text_only(spark, sf):
    return C.text_only(_posts(spark, sf))


@register("filter_lang", _w(_POSTS) + "\n" + _P1_SQL + " WHERE twitter_lang = 'en'")
def q_filter_lang(spark, sf):
    return C.filter_lang(_p1_strings(_posts(spark, sf)))


@register("drop_nulls", _w(_POSTS) + "\n" + _P1_SQL + " WHERE tag IS NOT NULL")
def q_drop_nulls(spark, sf):
    return C.drop_nulls(_p1_strings(_posts(spark, sf)))


@register("posted_date", _w(_POSTS) + """
SELECT postedTime, CAST(left(postedTime, 10) AS DATE) AS date FROM posts""")
def q_posted_date(spark, sf):
    return _posts(spark, sf).select("postedTime", posted_date(F.col("postedTime")).alias("date"))


# Date strings in five layouts derived from events.ts (the fifth is not a date).
_LENIENT_ORACLE = """
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(ts AS DATE) END AS date
FROM events"""


@register("lenient_date", _LENIENT_ORACLE)
def q_lenient_date(spark, sf):
    ev = read_table(spark, sf, "events")
    k = F.col("event_id") % 5
    s = (F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
          .when(k == 1, F.date_format("ts", "MM/dd/yyyy"))
          .when(k == 2, F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy"))
          .when(k == 3, F.date_format("ts", "d MMM yyyy"))
          .otherwise(F.concat(F.lit("not a date "), F.col("event_id").cast("string"))))
    return ev.select("event_id", lenient_date(s).alias("date"))


# Layouts of events.ts for the grammar of free dates; the last ones hold no
# date, an impossible one or one of two readings.
_LAYOUTS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss",
    "yyyyMMdd", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yy", "dd.MM.yyyy", "d.M.yy", "d MMM yyyy",
    "d MMMM yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMM d, yyyy h:mm a",
    "EEE MMM dd HH:mm:ss +0000 yyyy", "EEEE, d MMMM yyyy", "EEE, dd MMM yyyy HH:mm:ss -0800",
    "dd-MMM-yyyy", "dd-MMM-yy", "ddMMMyyyy", "yyyy MMM d", "yyyy年M月d日", "'the' d'th of' MMMM yyyy",
    "MMMM d'th', yyyy 'at' h a", "MMM. d, yyyy", "HH:mm:ss yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss+05:30",
    "  EEEE yyyy/M/d  ", "dd/MM/yyyy", "dd-MM-yyyy", "MMM yyyy", "yyyy-'02-30'", "'day' d MMM yyyy", "' '"]


@register("free_dates", f"""
SELECT event_id,
  CASE WHEN event_id % {len(_LAYOUTS)} < {_LAYOUTS.index("dd/MM/yyyy")} THEN CAST(ts AS DATE)
       WHEN event_id % {len(_LAYOUTS)} = {_LAYOUTS.index("dd/MM/yyyy")}
       THEN CASE WHEN day(ts) > 12 THEN CAST(ts AS DATE) ELSE make_date(year(ts), day(ts), month(ts)) END
       WHEN event_id % {len(_LAYOUTS)} = {_LAYOUTS.index("dd-MM-yyyy")}
       THEN CASE WHEN day(ts) > 12 OR day(ts) = month(ts) THEN CAST(ts AS DATE) END
  END AS date
FROM events""")
def q_free_dates(spark, sf):
    k = F.col("event_id") % len(_LAYOUTS)
    text = F.coalesce(*[F.when(k == i, F.date_format("ts", layout))
                        for i, layout in enumerate(_LAYOUTS)])
    return read_table(spark, sf, "events").select("event_id", free_date(text).alias("date"))


@register("rules_to_string", _w(_POSTS) + "\nSELECT tag, value FROM posts WHERE tag IS NOT NULL")
def q_rules_to_string(spark, sf):
    r = C.select_relevant(_posts(spark, sf)).where(F.col("tag").isNotNull())
    return r.select(C.rules_to_string(F.col("tag")).alias("tag"),
                    C.rules_to_string(F.col("value")).alias("value"))


@register("first_rule", _w(_POSTS) + """
SELECT CASE WHEN tag IS NULL OR tag = '[]' THEN NULL
            ELSE regexp_extract(tag, '^\\[([^,\\]]*)', 1) END AS firstTag
FROM posts""")
def q_first_rule(spark, sf):
    r = C.select_relevant(_posts(spark, sf))
    return r.select(C.first_rule(F.col("tag")).alias("firstTag"))


_CLEAN_COLS = "body, movieName, searchPattern, postedTime, retweetCount, twitter_lang, date"


@register("rename_chicago", _w(_POSTS, _CLEAN) + f"\nSELECT {_CLEAN_COLS} FROM clean")
def q_rename_chicago(spark, sf):
    return _clean(spark, sf, "chicago")


@register("rename_gnip", _w(_POSTS, f"clean AS ({O.clean_sql('gnip')})") + """
SELECT body, tag, movieName, postedTime, retweetCount, twitter_lang, date FROM clean""")
def q_rename_gnip(spark, sf):
    return _clean(spark, sf, "gnip")


@register("clean_tweets", _w(_POSTS, _CLEAN) + f"\nSELECT {_CLEAN_COLS} FROM clean")
def q_clean_tweets(spark, sf):
    return _clean(spark, sf, "chicago")


@register("movie_tweets", _w(_POSTS, _CLEAN) + """
SELECT body, movieName, date FROM clean WHERE movieName LIKE '%src1%'""")
def q_movie_tweets(spark, sf):
    return movie_filter(_clean(spark, sf), "src1").select("body", "movieName", "date")


@register("movie_sample", _w(_POSTS, _CLEAN) + """
SELECT body, movieName, date FROM clean WHERE movieName LIKE '%src1%'
ORDER BY date DESC, body LIMIT 10""")
def q_movie_sample(spark, sf):
    df = movie_filter(_clean(spark, sf), "src1").select("body", "movieName", "date")
    return df.orderBy(F.desc("date"), "body").limit(10)


# --- V/U: scoring and classification -----------------------------------------

@register("score_compound", _w(_DOC_SCORES) + """
SELECT d.*, s.vaderScore FROM documents d JOIN sc_out s ON d.doc_id = s.id""")
def q_score_compound(spark, sf):
    return _scored_docs(spark, sf, keep=None)


@register("score_all", _w(_DOC_SCORES) + """
SELECT d.doc_id, d.text AS body, neg, neu, pos, vaderScore AS comp
FROM documents d JOIN sc_out s ON d.doc_id = s.id""")
def q_score_all(spark, sf):
    return (_scored_docs(spark, sf, all_scores=True, keep=("doc_id", "text"))
            .withColumnRenamed("vaderScore", "comp").withColumnRenamed("text", "body"))


@register("score_rules", _w(f"bodies AS ({O.rule_bodies_sql()}),\n" + O.scorer_ctes("bodies", [])) + """
SELECT id AS doc_id, neg, neu, pos, vaderScore AS comp FROM sc_out""")
def q_score_rules(spark, sf):
    """Texts with an appended clause, so that every rule of the scorer fires."""
    lex, mods = _lex(spark)
    bodies = rule_bodies(read_table(spark, sf, "documents"))
    return (score_text(bodies, lex, mods, keep=["doc_id"], all_scores=True, min_partitions=TASKS)
            .withColumnRenamed("vaderScore", "comp"))


@register("score_phrases", _w(
    f"bodies AS ({O.rule_bodies_sql(O.PHRASE_CLAUSES)}),\n"
    + O.scorer_ctes("bodies", [], entries=O.PHRASES, idioms=O.IDIOMS, emoji=O.EMOJI)) + """
SELECT id AS doc_id, neg, neu, pos, vaderScore AS comp FROM sc_out""")
def q_score_phrases(spark, sf):
    """Texts with an appended clause that holds modifiers of up to five words,
    idioms or emoji."""
    lex, mods = phrase_lexicon(spark)
    bodies = rule_bodies(read_table(spark, sf, "documents"), PHRASE_CLAUSES)
    return (score_text(bodies, lex, mods, keep=["doc_id"], all_scores=True, min_partitions=TASKS)
            .withColumnRenamed("vaderScore", "comp"))


def _classify_sql(splits):
    return _w(_DOC_SCORES) + f"""
SELECT id AS doc_id, vaderScore, {O.class_case('vaderScore', splits)} AS vaderClassifier
FROM sc_out"""


@register("classify", _classify_sql(THRESHOLDS_DEFAULT))
def q_classify(spark, sf):
    return classify(_scored_docs(spark, sf), thresholds=THRESHOLDS_DEFAULT)


@register("classify_4way", _classify_sql(THRESHOLDS_4WAY))
def q_classify_4way(spark, sf):
    return classify(_scored_docs(spark, sf), thresholds=THRESHOLDS_4WAY)


@register("classify_thirds", _classify_sql(THRESHOLDS_THIRDS))
def q_classify_thirds(spark, sf):
    return classify(_scored_docs(spark, sf), thresholds=THRESHOLDS_THIRDS)


def punctuation_polarity(text):
    """Example user scorer for ``score_with``: (!s - ?s) / (1 + !s + ?s)."""
    ex = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    qm = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.round((ex - qm) / (ex + qm + 1), 6)


@register("score_custom", """
SELECT doc_id, round(((length(text) - length(replace(text, '!', '')))
                      - (length(text) - length(replace(text, '?', ''))))
                     / ((length(text) - length(replace(text, '!', '')))
                        + (length(text) - length(replace(text, '?', ''))) + 1), 6) AS vaderScore
FROM documents""")
def q_score_custom(spark, sf):
    docs = read_table(spark, sf, "documents")
    return score_with(docs, punctuation_polarity, text_col="text").select("doc_id", "vaderScore")


# --- A: aggregates -----------------------------------------------------------

@register("daily_counts", _w(_POSTS, _CLEAN) + """
SELECT date AS dateColumn, count(*) AS totalTweets FROM clean GROUP BY date""")
def q_daily_counts(spark, sf):
    return D.daily_counts(_clean(spark, sf))


@register("counts_by_class", _w(_CLS) + """
SELECT date, vaderClassifier, count(*) AS nTweets FROM cls GROUP BY date, vaderClassifier""")
def q_counts_by_class(spark, sf):
    return D.counts_by_class(_classified(spark, sf))


@register("daily_stats", _w(_CLS) + f"""
SELECT date, {O.stats_select('vaderScore')} FROM cls GROUP BY date""")
def q_daily_stats(spark, sf):
    return D.daily_stats(_classified(spark, sf))


@register("describe_daily_counts", _w(_POSTS, _CLEAN) + """,
d AS (SELECT date, count(*) AS c FROM clean GROUP BY date)
SELECT count(c) AS nDays, """ + O.exact_avg_sql("c", 0) + """ AS meanTweets, round(stddev_samp(c), 6) AS stdTweets,
       min(c) AS minTweets, max(c) AS maxTweets FROM d""")
def q_describe_daily_counts(spark, sf):
    return D.describe_daily_counts(_clean(spark, sf))


@register("describe_scores", _w(_DOC_SCORES) + ",\nl AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {e} AS v FROM sc_out"
    for c, e in [("neg", "neg"), ("neu", "neu"), ("pos", "pos"), ("comp", "vaderScore")]) + """)
SELECT "column", count(v) AS "count", """ + O.exact_avg_sql("v") + """ AS mean, round(stddev_samp(v), 6) AS stddev,
       min(v) AS "min", max(v) AS "max" FROM l GROUP BY "column\"""")
def q_describe_scores(spark, sf):
    return D.describe_scores(_scored_docs(spark, sf, all_scores=True)
                             .withColumnRenamed("vaderScore", "comp"))


@register("unique_movies", _w(_POSTS, _CLEAN) + "\n"
          + O.movies_found_sql().replace("AS name", "AS movieName"))
def q_unique_movies(spark, sf):
    return unique_movies(_clean(spark, sf))


@register("distinct_tags", _w(_POSTS, _CLEAN) + "\nSELECT DISTINCT movieName FROM clean")
def q_distinct_tags(spark, sf):
    return distinct_tags(_clean(spark, sf))


@register("row_counts", _w(_POSTS) + """
SELECT count(*) AS nRows, count(CASE WHEN tag IS NOT NULL THEN 1 END) AS nRowsNoNulls FROM posts""")
def q_row_counts(spark, sf):
    return D.row_counts(_p1_strings(_posts(spark, sf)),
                        ["body", "tag", "value", "postedTime", "retweetCount", "twitter_lang"])


@register("movie_match_counts", _w(_POSTS, _CLEAN, f"movies AS ({O.movies_found_sql('clean')})") + """
SELECT m.name AS movieName, count(*) AS nPosts
FROM clean c JOIN movies m ON c.movieName LIKE '%' || m.name || '%' GROUP BY m.name""")
def q_movie_match_counts(spark, sf):
    clean = _clean(spark, sf)
    per_string = clean.groupBy("movieName").agg(F.count(F.lit(1)).alias("n"))
    mapping = match_names(per_string.select("movieName"), unique_movies(per_string))
    return (per_string.join(mapping, "movieName").groupBy("name")
                      .agg(F.sum("n").alias("nPosts"))
                      .withColumnRenamed("name", "movieName"))


_DESCRIBED = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS "count", {mean} AS mean, {dev} AS stddev,
       CAST(min({c}) AS VARCHAR) AS "min", CAST(max({c}) AS VARCHAR) AS "max" FROM clean"""
    for c, mean, dev in [
        ("retweetCount", "round(avg(retweetCount), 6)", "round(stddev_samp(retweetCount), 6)"),
        ("movieName", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"),
        ("twitter_lang", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")])


@register("describe_frame", _w(_POSTS, _CLEAN) + "\n" + _DESCRIBED)
def q_describe_frame(spark, sf):
    return D.describe_frame(_clean(spark, sf).select("retweetCount", "movieName", "twitter_lang"))


@register("daily_percentiles", _w(_CLS) + """
SELECT date, round(quantile_cont(vaderScore, 0.25), 6) AS p25Score,
       round(quantile_cont(vaderScore, 0.5), 6) AS medianScore,
       round(quantile_cont(vaderScore, 0.75), 6) AS p75Score
FROM cls GROUP BY date""")
def q_daily_percentiles(spark, sf):
    return D.daily_percentiles(_classified(spark, sf))


@register("counts_wide", _w(_CLS) + """
SELECT date, count(CASE WHEN vaderClassifier = 0.0 THEN 1 END) AS nClass0,
       count(CASE WHEN vaderClassifier = 1.0 THEN 1 END) AS nClass1,
       count(CASE WHEN vaderClassifier = 2.0 THEN 1 END) AS nClass2,
       count(*) AS totalTweets
FROM cls GROUP BY date""")
def q_counts_wide(spark, sf):
    return D.counts_wide(_classified(spark, sf), len(THRESHOLDS_DEFAULT) - 1)


# --- O: sort, limit, set operations ------------------------------------------

@register("top_days", _w(_CLS) + f"""
SELECT date, {O.stats_select('vaderScore')} FROM cls GROUP BY date
ORDER BY totalTweets DESC, date DESC LIMIT 10""")
def q_top_days(spark, sf):
    return D.top_days(D.daily_stats(_classified(spark, sf)), 10)


@register("output_movies", _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + """
SELECT DISTINCT m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'""")
def q_output_movies(spark, sf):
    return D.output_movies(_daily(spark, sf).counts)


_GNIP_CLS = O.classified_ctes("gnip").replace("cls AS", "gcls AS").replace(
    "posts AS", "gposts AS").replace("FROM posts", "FROM gposts").replace(
    "clean AS", "gclean AS").replace("FROM clean", "FROM gclean").replace("sc_", "gsc_")


@register("union_outputs", _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})", _GNIP_CLS,
                              f"gmovies AS ({O.movies_found_sql('gclean')})") + """
SELECT 'chicago' AS dataset, s.date, s.vaderClassifier, count(*) AS nTweets, m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, s.vaderClassifier, m.name
UNION ALL
SELECT 'gnip' AS dataset, s.date, s.vaderClassifier, count(*) AS nTweets, m.name AS movieName
FROM gcls s JOIN gmovies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, s.vaderClassifier, m.name""")
def q_union_outputs(spark, sf):
    lex, mods = _lex(spark)
    chicago, gnip = PL.both_kinds(_posts(spark, sf), lex, mods, min_partitions=TASKS)
    return (chicago.counts.withColumn("dataset", F.lit("chicago"))
            .unionByName(gnip.counts.drop("chunkId").withColumn("dataset", F.lit("gnip"))))


# --- C: composed jobs --------------------------------------------------------

@register("movie_counts", _COUNTS_ORACLE)
def q_movie_counts(spark, sf):
    return _daily(spark, sf).counts


@register("movie_stats", _STATS_ORACLE)
def q_movie_stats(spark, sf):
    return _daily(spark, sf).stats


_QUANTILES = """round(quantile_cont(s.vaderScore, 0.05), 6) AS p5Score,
       round(quantile_cont(s.vaderScore, 0.25), 6) AS p25Score,
       round(quantile_cont(s.vaderScore, 0.5), 6) AS medianScore,
       round(quantile_cont(s.vaderScore, 0.75), 6) AS p75Score,
       round(quantile_cont(s.vaderScore, 0.95), 6) AS p95Score, count(*) AS totalTweets"""


@register("movie_percentiles", _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + f"""
SELECT s.date, {_QUANTILES}, m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%' GROUP BY s.date, m.name""")
def q_movie_percentiles(spark, sf):
    return _daily(spark, sf, quantiles=[0.05, 0.25, 0.5, 0.75, 0.95]).quantiles


@register("folder_percentiles", _w(O.classified_ctes("chicago", extra=["folder"]),
                                   f"movies AS ({O.movies_found_sql('clean', ['folder'])})") + f"""
SELECT s.folder, s.date, {_QUANTILES}, m.name AS movieName
FROM cls s JOIN movies m ON s.folder = m.folder AND s.movieName LIKE '%' || m.name || '%'
GROUP BY s.folder, s.date, m.name""")
def q_folder_percentiles(spark, sf):
    return _daily(spark, sf, keys=["folder"], quantiles=[0.05, 0.25, 0.5, 0.75, 0.95]).quantiles


_SUMMARY_ORACLE = _w(_CLS, f"movies AS ({O.movies_found_sql('clean')})") + f"""
SELECT m.name AS movieName, s.date, {O.stats_select()},
       count(CASE WHEN s.vaderClassifier = 0.0 THEN 1 END) AS nClass0,
       count(CASE WHEN s.vaderClassifier = 1.0 THEN 1 END) AS nClass1,
       count(CASE WHEN s.vaderClassifier = 2.0 THEN 1 END) AS nClass2
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, m.name"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    lex, mods = _lex(spark)
    return PL.daily_summary(_posts(spark, sf), lex, mods, min_partitions=TASKS)


register("daily_sentiment", _SUMMARY_ORACLE)(flagship)

_LISTED_ORACLE = _w(_CLS, "movies AS (SELECT DISTINCT source AS name FROM documents)") + """
SELECT s.date, s.vaderClassifier, count(*) AS nTweets, m.name AS movieName
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.date, s.vaderClassifier, m.name"""


@register("daily_sentiment_listed", _LISTED_ORACLE)
def q_daily_sentiment_listed(spark, sf):
    movies = read_table(spark, sf, "documents").select(F.col("source").alias("movieName")).distinct()
    return _daily(spark, sf, movies=movies).counts


@register("unique_movies_gnip", _w(_POSTS, f"clean AS ({O.clean_sql('gnip')})") + "\n"
          + O.movies_found_sql().replace("AS name", "AS movieName"))
def q_unique_movies_gnip(spark, sf):
    return unique_movies(_clean(spark, sf, "gnip"))


@register("movie_chunks", _CHUNKS_ORACLE)
def q_movie_chunks(spark, sf):
    return movie_chunks(unique_movies(_clean(spark, sf)))


_FOLDER_ORACLE = _w(O.classified_ctes("chicago", extra=["folder"]),
                    f"movies AS ({O.movies_found_sql('clean', ['folder'])})") + f"""
SELECT s.folder, s.date, {O.stats_select()}, m.name AS movieName, {_JOINED_COLUMNS}
FROM cls s JOIN movies m ON s.folder = m.folder AND s.movieName LIKE '%' || m.name || '%'
GROUP BY s.folder, s.date, m.name"""


@register("folder_daily", _FOLDER_ORACLE)
def q_folder_daily(spark, sf):
    out = _daily(spark, sf, keys=["folder"])
    return _joined_outputs(out.counts, out.stats, ["folder"])


_LISTED_FOLDER_ORACLE = _w(O.classified_ctes("chicago", extra=["folder"]),
                           "movies AS (SELECT DISTINCT source AS name FROM documents)") + f"""
SELECT s.folder, s.date, {O.stats_select()}, m.name AS movieName, {_JOINED_COLUMNS}
FROM cls s JOIN movies m ON s.movieName LIKE '%' || m.name || '%'
GROUP BY s.folder, s.date, m.name"""


@register("folder_daily_listed", _LISTED_FOLDER_ORACLE)
def q_folder_daily_listed(spark, sf):
    movies = read_table(spark, sf, "documents").select(F.col("source").alias("movieName")).distinct()
    out = _daily(spark, sf, keys=["folder"], movies=movies)
    return _joined_outputs(out.counts, out.stats, ["folder"])


def _chunk_ctes(src: str, prefix: str = "") -> str:
    return f"""{prefix}chunks AS (
  SELECT name, CAST(floor((row_number() OVER (ORDER BY name) - 1) / 10) AS INTEGER) AS chunkId
  FROM ({O.movies_found_sql(src)}))"""


_CHUNK_DAILY_ORACLE = _w(O.classified_ctes("gnip"), _chunk_ctes("clean")) + f"""
SELECT c.chunkId, s.date, {O.stats_select()}, c.name AS movieName, {_JOINED_COLUMNS}
FROM cls s JOIN chunks c ON s.movieName LIKE '%' || c.name || '%'
GROUP BY c.chunkId, s.date, c.name"""


@register("chunk_daily", _CHUNK_DAILY_ORACLE)
def q_chunk_daily(spark, sf):
    lex, mods = _lex(spark)
    out = PL.chunked_daily(_posts(spark, sf), lex, mods, kind="gnip", min_partitions=TASKS)
    return _joined_outputs(out.counts, out.stats, ["chunkId"])


_RUN_ALL_ORACLE = _w(O.classified_ctes("chicago", extra=["folder"]),
                     f"fmovies AS ({O.movies_found_sql('clean', ['folder'])})",
                     _GNIP_CLS, _chunk_ctes("gclean")) + f"""
SELECT 'folders' AS dataset, s.folder AS part, s.date, {O.stats_select()}, m.name AS movieName,
       {_JOINED_COLUMNS}
FROM cls s JOIN fmovies m ON s.folder = m.folder AND s.movieName LIKE '%' || m.name || '%'
GROUP BY s.folder, s.date, m.name
UNION ALL
SELECT 'chunks' AS dataset, CAST(c.chunkId AS VARCHAR) AS part, s.date, {O.stats_select()},
       c.name AS movieName, {_JOINED_COLUMNS}
FROM gcls s JOIN chunks c ON s.movieName LIKE '%' || c.name || '%'
GROUP BY c.chunkId, s.date, c.name"""


@register("run_all", _RUN_ALL_ORACLE)
def q_run_all(spark, sf):
    """The whole workflow: folders of the chicago kind and chunks of the gnip
    kind from one scoring pass, both outputs written in the partitioned layout
    and read back."""
    lex, mods = _lex(spark)
    chicago, gnip = PL.both_kinds(_posts(spark, sf, with_folder=True), lex, mods, keys=["folder"],
                                  min_partitions=TASKS)
    root, parts = shared_dir(spark, "run-all"), []
    for name, out, by, kind in (("folders", chicago, "folder", "string"),
                                ("chunks", gnip, "chunkId", "int")):
        K.write_daily(out.counts, out.stats, f"{root}/{name}", partition_by=[by])
        both = _joined_outputs(
            K.read_counts(spark, f"{root}/{name}/counts/daily", [(by, kind)]),
            K.read_stats(spark, f"{root}/{name}/stats/daily", [(by, kind)]), [by])
        parts.append(both.withColumn("dataset", F.lit(name))
                         .withColumn("part", F.col(by).cast("string")).drop(by))
    chicago.close()
    return parts[0].unionByName(parts[1])
