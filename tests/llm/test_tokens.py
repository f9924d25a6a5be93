"""BPE and edit-aware counts against the reference encoder."""

import random
import sys
import zlib

import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sentimart.llm import bpe, sharding, tokens
from sentimart.llm.common import table
from llm_helpers import LONG, SF, documents, odd_rows

TEXTS = ["", " ", "\n\n", "Hello  world it's I'll we'VE 123 4567 !!! ...", LONG[:5000],
         "a" * 3000, "ab" * 2000, "\x1c\x1d\x85\u00a0\u2028\u3000x \u200b y", "漢字🙂🙂é" * 50,
         "tabs\t\tand\r\n\r\n  spaces   ", "<|endoftext|> is text", "٣٤ Ⅷ ²½"]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_encode_like_the_library(tokenizer, k):
    ranks, pattern, enc = tokenizer
    got = bpe.encode_text(TEXTS[k], regex.compile(pattern).findall, bpe.Pieces(ranks))
    assert got.tolist() == enc.encode_ordinary(TEXTS[k])


def test_generations_of_pieces_change_no_id(tokenizer, monkeypatch):
    ranks, pattern, enc = tokenizer
    monkeypatch.setattr(bpe, "CACHE", 7)
    find, pieces = regex.compile(pattern).findall, bpe.Pieces(ranks)
    for text in [*TEXTS, *TEXTS]:
        assert bpe.encode_text(text, find, pieces).tolist() == enc.encode_ordinary(text)
        assert len(pieces) <= 7 and len(pieces.before) <= 7


def test_remembered_pieces_are_bounded_in_bytes(monkeypatch):
    """Long pieces (scripts without spaces) weigh many times a short one."""
    monkeypatch.setattr(bpe, "ROOM", 1 << 20, raising=False)
    ranks = {bytes([i]): i for i in range(256)}
    pieces = bpe.Pieces(ranks)
    for i in range(2000):
        piece = chr(0x4E00 + i) * 200
        assert pieces[piece] == b"".join(bytes([b, 0, 0, 0]) for b in piece.encode())
    size = sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (pieces, pieces.before) for k, v in d.items())
    assert 1 << 20 <= size < (2 << 20) + 10_000


def test_result_batches_are_bounded_in_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "_BYTES", 1000, raising=False)
    texts = [None, "", "x" * 400, "x" * 500, "é" * 100, "x" * 5000, "y", *["z"] * 600]
    lists = [None if t is None else list(range(len(t.encode()) // 4)) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(lists, pa.list_(pa.int32())),
                                        pa.nulls(len(texts))], names=["t", "l", "n"])
    for at in range(3):
        parts = list(bpe._parts(batch, at))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        assert max(p.num_rows for p in parts) == 256 and min(p.num_rows for p in parts) > 0
    sizes = [[len((t or "").encode()) for t in p.column(0).to_pylist()] for p in bpe._parts(batch, 0)]
    assert all(sum(x) <= 1000 or len(x) == 1 for x in sizes) and [5000] in sizes
    assert list(bpe._parts(batch.slice(0, 0), 0)) == []


def test_every_character_is_cut_like_the_library(tokenizer):
    ranks, pattern, enc = tokenizer
    find, pieces = regex.compile(pattern).findall, bpe.Pieces(ranks)
    odd = []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0xD7FF or c >= 0x1FB00:
            continue
        t = f"a{chr(c)}{chr(c)} 1"
        if len(find(t)) != len(enc._core_bpe.encode_ordinary(t)) and \
                bpe.encode_text(t, find, pieces).tolist() != enc.encode_ordinary(t):
            odd.append(hex(c))
    assert odd == []


def test_round_trip_of_a_table(spark, tokenizer, shared):
    docs = table(spark, SF, "documents").unionByName(
        documents(spark, odd_rows()).select("doc_id", "text", "lang", "source", "n_chars"))
    both = bpe.decode(bpe.encode(docs, shared, tokenizer[1]), shared)
    once = bpe.encode_decode(docs, shared, tokenizer[1])
    assert both.columns == once.columns == [*docs.columns, "token_ids", "decoded"]
    assert sorted(map(str, both.collect())) == sorted(map(str, once.collect()))
    for r in both.collect():
        assert r.token_ids == tokenizer[2].encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(docs.limit(0), shared, tokenizer[1]).count() == 0


def test_fold_in_higher_order_functions(spark, tokenizer):
    ranks, pattern, enc = tokenizer
    words = sorted({w for t in TEXTS for w in regex.findall(pattern, t) if len(w) < 300}
                   | {"", "é", "漢字", "a" * 70, "aaab", "abab"}) + [None]
    small = {p: r for p, r in ranks.items() if r < 3000}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for known in (small, ranks):
        found = bpe.decode_words(bpe.encode_words(df, known), known).collect()
        assert len(found) == len(words)
        for r in found:
            assert r.token_ids == (bpe.merge(r.word.encode(), known) if r.word else []), r.word
            assert bytes(r.decoded) == (r.word or "").encode()
    assert bpe.encode_words(df.limit(0), small).count() == 0


def test_fold_over_the_distinct_words_of_a_table(spark, tokenizer):
    ranks, pattern, enc = tokenizer
    texts = [r.text for r in table(spark, SF, "documents").collect()]
    words = sorted({w for t in texts if t for w in regex.findall(pattern, t)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for r in bpe.encode_words(df, ranks).collect():
        assert r.token_ids == enc.encode_ordinary(r.word), r.word


def test_tree_against_whole_recounts(tokenizer):
    ranks, pattern, enc = tokenizer
    rng = random.Random(3)
    find, pieces = regex.compile(pattern).findall, bpe.Pieces(ranks)
    bits = ["", " ", "a", "\n", "  ", "It's", " the end. ", "'", "ll", "x" * 300, "12", "é漢",
            "\n\n  ", "word " * 200]
    for text in TEXTS:
        tree = tokens.Tree(text, find, pieces)
        for _ in range(60):
            pos, n, ins = rng.randint(-2, len(text) + 3), rng.choice([0, 1, 2, 5, 400]), rng.choice(bits)
            tree.edit(pos, n, ins)
            at = min(max(pos, 0), len(text))
            text = text[:at] + ins + text[at + n:]
            assert tree.n_chars == len(text)
            assert tree.n_tokens == len(enc.encode_ordinary(text)), (pos, n, ins)
        assert "".join(tree.text) == text


def test_small_edits_recut_little(tokenizer):
    ranks, pattern, _ = tokenizer
    tree = tokens.Tree(LONG, regex.compile(pattern).findall, bpe.Pieces(ranks))
    tree.edit(len(LONG) // 2, 3, "new")
    assert 0 < tree.recut_chars < 3000 < len(LONG)


def test_edits_of_a_table(spark, tokenizer, shared):
    docs = documents(spark, odd_rows()).withColumn("edits", F.expr(
        "array(struct(3 as pos, 2 as n_del, 'zz top' as ins), null, "
        "struct(100000000 as pos, 5 as n_del, ' end' as ins), "
        "struct(cast(null as int) as pos, 1 as n_del, cast(null as string) as ins))"))
    out = tokens.count_after_edits(docs, shared, tokenizer[1]).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        t = r.text or ""
        assert r.counts.tokens_before == len(tokenizer[2].encode_ordinary(t))
        t = t[:3] + "zz top" + t[5:] + " end"
        assert r.counts.tokens_after == len(tokenizer[2].encode_ordinary(t[1:]))
    none = docs.withColumn("edits", F.lit(None).cast(tokens.EDITS))
    for r in tokens.count_after_edits(none, shared, tokenizer[1]).collect():
        assert r.counts.tokens_before == r.counts.tokens_after and r.counts.chars_recut == 0
    assert tokens.count_after_edits(docs.limit(0), shared, tokenizer[1]).count() == 0


def test_kept_trees_over_several_batches(spark, tokenizer, shared):
    """Every batch reads the parts of its documents, re-encodes little, and all
    counts equal a whole recount."""
    rng, enc = random.Random(8), tokenizer[2]
    texts = {i: t or "" for i, t in odd_rows() if i is not None}
    texts |= {100 + i: f"Document {i}. " * rng.randrange(1, 400) for i in range(60)}
    rows = [(i, t, 1, "x") for i, t in texts.items()] + [(None, "gone", 1, "x")]
    store = tokens.TreeStore(spark, shared, tokenizer[1], parts=16)
    store.create(spark.createDataFrame(rows, "doc_id long, text string, batch int, leaves string"))
    for batch in range(3):
        some = {i: [(rng.randint(0, len(texts[i])), rng.choice([0, 3, 40]), rng.choice(["", " new", "It's\n\n12"]))
                    for _ in range(rng.randrange(4))] for i in rng.sample(sorted(texts), 3)}
        some[900 + batch] = [(0, 0, "a new document")]
        for i, edits in some.items():
            for at, n, ins in edits:
                old = texts.get(i, "")
                at = min(at, len(old))
                texts[i] = old[:at] + ins + old[at + n:]
        df = spark.createDataFrame(list(some.items()),
                                   "doc_id long, edits array<struct<pos:int,n_del:int,ins:string>>")
        before = {r.doc_id: r.n_tokens for r in store.counts().collect()}
        got = store.apply(df)
        out = {r.doc_id: r for r in got.collect()}
        assert out.keys() == some.keys()
        for i, r in out.items():
            assert r.tokens_before == before.get(i, 0)
            assert r.tokens_after == len(enc.encode_ordinary(texts[i]))
            assert r.chars_recut <= len(some[i]) * 1500 and r.chars == len(texts[i])
        assert {r.doc_id: r.n_tokens for r in store.counts().collect()} == {
            i: len(enc.encode_ordinary(t)) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in store.texts().collect()} == texts
    # a count reads no text, a batch only the parts of its documents
    plan = store.counts()._jdf.queryExecution().executedPlan().toString()
    assert "leaves" not in plan
    with pytest.raises(Exception, match="several edit rows"):
        store.apply(df.unionByName(df))
    store.close()


def test_query_matches_the_library(spark, tokenizer):
    from sentimart.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    enc = tokenizer[2]
    for r in QUERIES["op3_token_counts"](spark, SF).collect():
        t = texts[r.doc_id]
        n = len(t)
        assert r.tokens_before == len(enc.encode_ordinary(t))
        t = t[:n // 3] + t[n // 3 + 9:]
        t = t[:n // 2] + f" (rev. {r.doc_id})\n\nIt's 2024  now" + t[n // 2:]
        at = max(n - 12, 0)
        t = t[:at] + "é’ll" + t[at + 3:]
        assert r.tokens_after == len(enc.encode_ordinary(t))


# --- sharding -------------------------------------------------------------------

def test_differencing_beats_greedy_and_is_consistent():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10_000) for _ in range(500)]
    sums, places = sharding.difference([[s, 0, 0, 0, 0] for s in sizes])
    again = [0] * 5
    for s, p in zip(sizes, places):
        again[p[0]] += s
    assert again == sums and max(sums) - min(sums) < 50
    sums, places = sharding.difference([[4, 0], [5, 0], [6, 0], [7, 0], [8, 0]])
    assert sorted(sums) == [14, 16]      # the textbook example


@pytest.mark.parametrize("shards,parts,at_once", [(24, None, 1024), (5, 3, 1024), (1, 2, 1024),
                                                  (6, 11, 3)])
def test_shards(spark, shards, parts, at_once, monkeypatch):
    """The last: parts combined in a middle level."""
    monkeypatch.setattr(sharding, "PARTS", at_once)
    rows = odd_rows() + [(100 + i, "copy " * 40) for i in range(300)] + [
        (1000 + i, "w" * (i % 97)) for i in range(600)] + [(None, "copy " * 40)] * 200
    docs = documents(spark, rows)
    out = sharding.shard(docs, shards, parts).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in out
                  if r.doc_id is not None) == sorted(
        (False, i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode()))
        for i, t in rows if i is not None)
    by, home = {}, {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
        if r.text_crc32 is not None:
            assert home.setdefault((r.text_crc32, r["size"]), r.shard) == r.shard
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    again = sharding.shard(docs.repartition(7), shards, parts).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sharding.shard(docs.limit(0), shards, parts).count() == 0


@pytest.mark.parametrize("groups,at_once", [(200_000, 1024), (40, 4)])
def test_shards_are_even(spark, groups, at_once, monkeypatch):
    monkeypatch.setattr(sharding, "GROUPS", groups)   # the number of parts follows the groups
    monkeypatch.setattr(sharding, "PARTS", at_once)
    out = sharding.shard(table(spark, "/root/testdata/sf0.01", "documents"))
    sums = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) < 0.002 * sum(sums) / 24
