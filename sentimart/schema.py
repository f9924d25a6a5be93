"""Declared schemas, output column lists and threshold presets."""

from __future__ import annotations

from pyspark.sql import types as T

RULE_TYPE = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("value", T.StringType()),
])
RULES_TYPE = T.ArrayType(RULE_TYPE)

# Field names of the posts. Raw post as written by the collector (JSON lines, usually gzip). Only the
# fields the job reads are declared; other JSON fields are ignored by the
# reader, so no inference pass is needed.
POST_SCHEMA = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("gnip", T.StructType([T.StructField("matching_rules", RULES_TYPE)])),
    T.StructField("postedTime", T.StringType()),
    T.StructField("retweetCount", T.LongType()),
    T.StructField("twitter_lang", T.StringType()),
])

CORRUPT_COLUMN = "_corrupt_record"
POST_SCHEMA_WITH_CORRUPT = T.StructType(
    POST_SCHEMA.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())]
)

# Column names of the outputs.
# Output 1: class counts per movie and day.
COUNTS_COLUMNS = ["date", "vaderClassifier", "nTweets", "movieName"]
COUNTS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("vaderClassifier", T.DoubleType()),
    T.StructField("nTweets", T.LongType()),
    T.StructField("movieName", T.StringType()),
])

# Output 2: score statistics per movie and day.
STATS_COLUMNS = ["date", "avgScore", "stdDev", "minScore", "maxScore",
                 "totalTweets", "movieName"]
STATS_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("avgScore", T.DoubleType()),
    T.StructField("stdDev", T.DoubleType()),
    T.StructField("minScore", T.DoubleType()),
    T.StructField("maxScore", T.DoubleType()),
    T.StructField("totalTweets", T.LongType()),
    T.StructField("movieName", T.StringType()),
])

MOVIE_LIST_SCHEMA = T.StructType([
    T.StructField("movieName", T.StringType()),
    T.StructField("chunkId", T.IntegerType()),
])

# Threshold sets used by the original job and its workflow.
THRESHOLDS_DEFAULT = [-1.0, -0.5, 0.5, 1.0]
THRESHOLDS_4WAY = [-1.0, -0.5, 0.0, 0.5, 1.0]
THRESHOLDS_WORKFLOW = [-1.0, -0.333, 0.333, 1.0]
THRESHOLDS_THIRDS = [-1.0, -1.0 / 3.0, 1.0 / 3.0, 1.0]

# Movie names per chunk in the gnip workflow.
CHUNK_SIZE = 10

# Rounding used for reported statistics so results are stable across engines.
STATS_DECIMALS = 6
