"""Staged files: their number follows the data, not a fixed figure."""

import glob

import pytest
from pyspark.sql import functions as F

from sentimart import queries as Q


def _documents(spark, folder, rows):
    """``documents`` of texts that do not compress, in eight files."""
    text = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f"/{k}")), 256) for k in range(8)])
    spark.range(0, rows, 1, 8).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("src"), F.col("id") % 20).alias("source"),
        F.lit(519).cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", [Q._stage_posts, Q._stage_with_malformed])
def test_a_staged_file_does_not_grow_with_the_input(spark, tmp_path, stage):
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        files, most = [], []
        for rows in (4000, 16000):
            lines = spark.read.text(stage(spark, _documents(spark, tmp_path / f"d{rows}", rows)))
            assert lines.where("value != ''").count() == rows
            per_file = lines.groupBy(F.col("_metadata.file_path")).count().collect()
            files.append(len(per_file))
            most.append(max(r["count"] for r in per_file))
        assert files[1] >= 2 * files[0]
        assert most[1] < 2 * most[0]
    finally:
        for k in sizes:
            spark.conf.unset(k)


def test_an_empty_table_is_staged(spark, tmp_path):
    sf = _documents(spark, tmp_path / "none", 0)
    assert Q.q_load_tweets(spark, sf).count() == 0
    assert {(r.side, r.nRows) for r in Q.q_split_malformed(spark, sf).collect()} == set()
