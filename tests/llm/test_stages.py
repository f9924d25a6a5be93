"""Quality rules, substring dedup, mixing and the pipeline."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sentimart.llm import mixing, quality, substring
from sentimart.llm.common import table
from sentimart.llm.queries import ORACLE, QUERIES
from llm_helpers import LONG, PARA, SF, components, documents, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality ------------------------------------------------------------------

def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1
               for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark):
    rows = odd_rows() + [(20, "a b a b a b"), (21, "x y z\nx y z\n\n \nx y z"), (22, "# * | a<b>"),
                         (23, "a b c a b c d"), (24, "one two")]
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                   r.n_repeat_words) for r in quality.judge(docs, ["doc_id"]).collect())
    assert got == Counter((i, *brute_counts(t)) for i, t in rows)
    for r in quality.judge(docs, ["doc_id"]).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_verdict_and_columns(spark):
    good = " ".join(f"the quick brown fox{i} and dog{i}" for i in range(30))
    bad = " ".join(f"%%%{i} $$$" for i in range(60))
    docs = documents(spark, [(1, good), (2, bad), (3, None), (4, good.upper().replace(" ", "!! "))])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
    assert quality.keep_good(docs, rules=[]).count() == 3
    assert quality.keep_good(docs.limit(0)).count() == 0
    plan = quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_quality_tells_labelled_documents_apart(spark):
    sf = "/root/testdata/sf0.01"
    j = quality.judge(table(spark, sf, "documents"), ["doc_id"]).where("not base_failed")
    j = j.join(table(spark, sf, "labels"), "doc_id").select("quality", "kept").collect()
    assert all(r.kept == (r.quality == 1) for r in j) and len(j) > 100


# --- substring ----------------------------------------------------------------

def brute_spans(counts, ms, mw, lw):
    """Shortest runs by their definition."""
    n = len(counts)
    ok = {(i, j) for i in range(n) for j in range(i, n)
          if j - i + 1 >= ms and sum(counts[i:j + 1]) >= mw}
    out = {(i, i) for i, c in enumerate(counts) if c >= lw}
    for i in range(n):
        ends = [j for a, j in ok if a == i]
        out |= {(i, min(ends))} if ends else set()
    for j in range(n):
        starts = [i for i, b in ok if b == j]
        out |= {(max(starts), j)} if starts else set()
    return sorted(out)


@pytest.mark.parametrize("counts", [[], [3], [50], [10, 10], [5, 5, 5, 5, 5, 5, 40, 1, 1, 19, 1],
                                    [0, 0, 20, 0, 3, 30, 2], [7] * 12])
def test_spans(counts):
    assert substring.spans(counts, 2, 20, 30) == brute_spans(counts, 2, 20, 30)


@pytest.mark.parametrize("text", ["", "a", "One. Two!  three? Four\n\n five Six", "É. à Ö x", LONG])
def test_sentences_join_to_the_text(text):
    assert "".join(substring.sentences(text)) == text


def brute_dedup(rows):
    """Global first places by sorting all runs of the distinct documents."""
    places = defaultdict(list)
    docs = sorted({(2 ** 63 - 1 if i is None else i, t) for i, t in rows if t})
    for i, t in docs:
        for h, a, b in substring.runs(t, 2, 20, 30):
            places[h].append((i, t, a, b))
    gone = defaultdict(set)
    for found in places.values():
        first = min((i, a) for i, _, a, _ in found)
        for i, t, a, b in found:
            if (i, a) != first:
                gone[i, t].update(range(a, b + 1))
    return {(i, t): "".join(s for k, s in enumerate(substring.sentences(t)) if k not in gone[i, t])
            for i, t in docs}


def test_substring_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_dedup(rows)
    got = {(r.doc_id, r.text) for r in substring.dedup_spans(docs).collect()}
    assert got == {(i, want[i, t]) for i, t in rows}
    assert any(want[i, t] != t for i, t in rows)


def test_passage_inside_other_sentences(spark):
    passage = ("Every run of several sentences is hashed so that this can be found. It was planted "
               "in two documents that share nothing else. Nobody would miss the second of them, and "
               "the first one must stay as it was before.")
    a = "Alpha starts here and goes on. Then some words and " + passage + " more of alpha follows."
    b = "Beta is another thing. It has its own words, but " + passage + " beta goes on. The end."
    docs = documents(spark, [(1, a), (2, b), (3, "Gamma has nothing to do with it. Nothing.")])
    got = {r.doc_id: r for r in substring.dedup_spans(docs).collect()}
    assert got[1].text == a and got[1]._x_removed == 0
    assert got[2].text == ("Beta is another thing. It has its own words, but beta goes on. The end.")
    assert got[3]._x_removed == 0 and got[3].asDict().keys() == {*docs.columns, "_x_removed"}


def test_every_51_equal_words_lose_some(spark):
    import random

    rng = random.Random(7)
    rows, stretch = [], {}
    for k in range(60):
        passage = [f"p{rng.randrange(10 ** 6)}" for _ in range(51)]
        for at in {rng.randrange(1, 51) for _ in range(k % 4)}:     # sentence ends inside it
            passage[at - 1] += "."
        for copy in (0, 1):
            own = [[f"w{rng.randrange(10 ** 9)}" for _ in range(rng.randrange(1, 60))]
                   for _ in range(2)]
            rows.append((2 * k + copy, " ".join(own[0] + passage + own[1]) + "."))
        stretch[2 * k + 1] = (set(passage), {w.rstrip(".") for o in own for w in o})
    got = {r.doc_id: r.text for r in substring.dedup_spans(documents(spark, rows)).collect()}
    for i, t in rows:
        if i % 2 == 0:
            assert got[i] == t
        else:
            left = [w for w in got[i].split() if w in stretch[i][0]]
            assert len(left) <= 31
            assert stretch[i][1] <= {w.rstrip(".") for w in got[i].split()}


def test_substring_odd_rows(spark):
    docs = documents(spark, odd_rows())
    out = substring.dedup_spans(docs).collect()
    assert len(out) == len(odd_rows())
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [" \n\t "] and by[8] == ["x" * 30_000]
    assert by[5] == [PARA]               # the passage repeats inside the text
    assert by[6] == ["", ""]             # repeated rows share their result
    assert sorted(by[None], key=str) == ["", None]
    assert substring.dedup_spans(docs.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10}, {"a": 100, "b": 1, "c": 1, None: 50}, {"a": 0, "b": 5}, {"x": 0},
    {f"s{i}": (i * 37) % 101 for i in range(23)}, {"a": 5, "b": 2, "c": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


@pytest.mark.parametrize("ranges", [1, 7])
def test_mix(spark, ranges):
    rows = [(i, " ".join(["w"] * (i * 13 % 57)), "hot" if i % 3 else f"s{i % 5}")
            for i in range(300)]
    rows += [(1000, None, None), (1001, "a b c", None), (7, rows[7][1], "hot"), (None, "q", "s1")]
    docs = documents(spark, rows)
    got = mixing.mix(docs, ranges=ranges).collect()
    again = mixing.mix(docs.repartition(5), ranges=3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by[r.source].append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    for s, want in brute_targets(sizes).items():
        assert by[s][0].target == pytest.approx(want) and by[s][0].source_size == sizes[s]
        assert abs(sum(r.taken for r in by[s]) - want) <= 0.5
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 == mixing.mixed_rows(docs.limit(0)).count()


def test_mix_is_native(spark):
    plan = mixing.mix(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


# --- queries with SQL -----------------------------------------------------------

@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[key](spark, SF)
    rel = con.sql(ORACLE[key])
    assert sorted(df.columns) == sorted(rel.columns)
    got = Counter(tuple(r[c] for c in rel.columns) for r in df.collect())
    assert got == Counter(rel.fetchall())


def test_equal_rows_on_the_cut_are_handed_out_exactly(spark):
    rows = ([(None, "one two three", "a")] * 900 + [(None, "one two three", "b")] * 100
            + [(7, "four five", None)] * 3 + [(8, "six", "b")])
    docs = documents(spark, rows).repartition(5)
    due, got = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        due[r.source] += r.copies
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.source] += 1
    assert got == due and len(got) == 3
    want, words = brute_targets({"a": 2700, "b": 301, None: 6}), Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    assert all(want[s] - 1 <= words[s] < want[s] + 3 for s in want)


# --- pipeline -------------------------------------------------------------------

def test_pipeline_against_brute_force(spark, tokenizer):
    import corpus_pipeline
    from sentimart.llm.simhash import fingerprint

    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs, ["doc_id"]).collect() if r.kept}
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "substring dedup",
        "mixing sources to target weights", "byte-level BPE"]
    fps = {i: fingerprint(rows[i].text) for i in kept}
    ids = sorted(kept)
    comp = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k]
                            if (fps[a] ^ fps[b]).bit_count() <= 2])
    ids = [i for i in ids if comp[i] == i]
    cut = brute_dedup([(i, rows[i].text) for i in ids])
    texts = {i: cut[i, rows[i].text] for i in ids}
    texts = {i: t for i, t in texts.items() if WORD.search(t)}
    sizes = defaultdict(int)
    for i, t in texts.items():
        sizes[rows[i].source] += len(WORD.findall(t))
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= set(texts)
    words = defaultdict(int)
    for r in out:
        assert r.round_trip and r.token_ids == tokenizer[2].encode_ordinary(texts[r.doc_id])
        assert (r.source, r.lang, r.n_tokens) == (rows[r.doc_id].source, rows[r.doc_id].lang,
                                                  len(r.token_ids))
        words[r.source] += len(WORD.findall(texts[r.doc_id]))
    most = {s: max(len(WORD.findall(t)) for i, t in texts.items() if rows[i].source == s)
            for s in sizes}
    for s, want in brute_targets(sizes).items():
        assert want - 1 <= words[s] <= want + most[s]


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = documents(spark, odd_rows())
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            out.collect()
            if name != "byte-level BPE":
                assert out.columns == docs.columns, name
