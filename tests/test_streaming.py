"""Streaming over a growing folder equals the batch job over the same files."""

from collections import Counter

from sf_paths import SF_SMALL
from sentimart.plans import daily as PL
from sentimart.sources import posts as S
from sentimart.sources import sinks as K
from sentimart.sources.fixture import fixture_lexicon, fixture_posts
from sentimart.streaming.daily import (compact_partials, outputs_from_partials, partial_rows,
                                       start_partials)


def test_stream_equals_batch(spark, tmp_path):
    lex, mods = fixture_lexicon(spark)
    posts = fixture_posts(spark, SF_SMALL, with_id=True)
    src = str(tmp_path / "src")
    # two arrivals: the second batch of files lands after the first run
    K.write_posts_json(posts.where("doc_id < 100").drop("doc_id"), src + "/a", files=2)
    q = start_partials(spark, src + "/*", str(tmp_path / "partials"), str(tmp_path / "ckpt"),
                       lex, mods)
    q.awaitTermination()
    K.write_posts_json(posts.where("doc_id >= 100").drop("doc_id"), src + "/b", files=2)
    q = start_partials(spark, src + "/*", str(tmp_path / "partials"), str(tmp_path / "ckpt"),
                       lex, mods)
    q.awaitTermination()
    streamed = outputs_from_partials(spark, str(tmp_path / "partials"))
    batch = PL.daily_sentiment(S.read_posts(spark, [src + "/a", src + "/b"]), lex, mods,
                               persist=False)
    assert Counter(tuple(r) for r in streamed.counts.collect()) == \
        Counter(tuple(r) for r in batch.counts.collect())
    assert Counter(tuple(r) for r in streamed.stats.collect()) == \
        Counter(tuple(r) for r in batch.stats.collect())


def test_compaction_changes_no_output(spark, tmp_path):
    """Merged batches give the same outputs; files of the state before stay for
    one more call; an unfinished merge is not seen; a repeated call does nothing."""
    lex, mods = fixture_lexicon(spark)
    posts = fixture_posts(spark, SF_SMALL, with_id=True).where("doc_id < 150")
    src, partials = str(tmp_path / "src"), tmp_path / "partials"

    def run(part):
        K.write_posts_json(posts.where(f"doc_id % 3 = {part}").drop("doc_id"), f"{src}/{part}",
                           files=2)
        start_partials(spark, src + "/*", str(partials), str(tmp_path / "ckpt"), lex, mods,
                       max_files_per_trigger=1).awaitTermination()

    def outputs():
        out = outputs_from_partials(spark, str(partials))
        return (Counter(tuple(r) for r in out.counts.collect()),
                Counter(tuple(r) for r in out.stats.collect()))

    def folders(root):
        return {f.name for f in root.iterdir() if "=" in f.name}

    assert compact_partials(spark, str(tmp_path / "nothing")) is None
    run(0)
    run(1)
    want = outputs()
    assert compact_partials(spark, str(partials)) == 2
    merged = tmp_path / "partials-merged"
    assert folders(partials) == {f"batchId={i}" for i in range(4)}
    assert outputs() == want
    assert compact_partials(spark, str(partials)) == 2 and outputs() == want
    # a merge that was lost before its rename
    (merged / "_staged-lost").mkdir()
    run(2)
    want = outputs()
    assert compact_partials(spark, str(partials)) == 4
    assert folders(partials) == {"batchId=3", "batchId=4", "batchId=5"}
    assert folders(merged) == {"upTo=2", "upTo=4"}
    assert outputs() == want
    assert partial_rows(spark, str(partials)).schema["s"].dataType == \
        spark.read.parquet(str(partials / "batchId=5")).schema["s"].dataType
    batch = PL.daily_sentiment(S.read_posts(spark, [f"{src}/{i}" for i in range(3)]), lex, mods,
                               persist=False)
    assert want[0] == Counter(tuple(r) for r in batch.counts.collect())
