"""Spelling variants against a brute-force version of the contract."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from llm_helpers import LONG, SF, documents, odd_rows
from sentimart.llm import spelling as S

UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    holes, shorter = defaultdict(set), defaultdict(set)
    for w in n:
        if len(w) > 200:   # alone in these tests
            continue
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            shorter[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    for u, longer in shorter.items():
        if u in n:
            near[u] |= longer
            for w in longer:
                near[w].add(u)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    from sentimart.llm.queries import QUERIES
    big = SF.replace("0.001", "0.01")
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{big}/documents.parquet'").fetchall()
    exp = brute(rows)
    assert any(r[1] for r in exp) and any(r[4] > 3 for r in exp)
    assert got(QUERIES["op11_spelling"](spark, big)) == exp


def chains():
    """Words that differ by one character in every way, chains of forms, ties."""
    words = {"kitten": 3125, "kittens": 625, "kittens": 625, "mittens": 125, "mitten": 625,
             "aaaaaa": 40, "aaaaaaa": 200, "aaaabaa": 40, "baaaaaa": 40, "aaaaaab": 8,
             "abcdef": 25, "abcdeg": 125, "abcdeh": 125, "àbcdef": 5, "abcdefé": 5, "xabcdef": 5,
             "ÀÖÜßÿé": 30, "ÀÖÜßÿèé": 6, "short": 90, "fourxx": 4, "zzzzzz": 5, "zzzzzy": 24}
    rows = [(i, " ".join([w] * k + ["-"])) for i, (w, k) in enumerate(words.items())]
    return rows + [(50 + i, "Differs, differS; diffErs difFers differs differx " + "q" * 9) for i in range(40)]


@pytest.mark.parametrize("ranges", [1, 4, 37])
def test_every_kind_of_neighbour(spark, ranges):
    rows = chains() + odd_rows() + odd_rows() + [(None, LONG), (77, LONG)] * 2
    assert got(S.variants(documents(spark, rows), ranges=ranges)) == brute(rows)


def test_very_long_runs(spark):
    """Work follows the length of a word, not its square."""
    run = "y" * 20_000
    rows = [(i, f"{run} {run}z {run}z") for i in range(6)]
    out = {(len(r.word), r.n, r.n_near) for r in S.variants(documents(spark, rows)).collect()}
    exp = Counter(len(w) for i, t in rows for w in t.split())
    assert out == {(k, c, 1) for k, c in exp.items()}


def test_empty_table(spark):
    assert got(S.variants(documents(spark, []))) == set()


def test_nodes_are_numbered_as_a_trie(spark):
    """Equal numbers for equal prefixes and for nothing else, over all ranges."""
    import pyarrow as pa

    words = sorted({w for r in brute(chains() + odd_rows() * 2) for w in [r[0]]} | {"a", "ab", "abc", ""})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(5)

    def emit(out):
        yield pa.RecordBatch.from_arrays([pa.array([w for _, w, _, _ in out]),
                                          pa.array([o for _, _, o, _ in out], pa.int64()),
                                          pa.array([n for *_, n in out], pa.list_(pa.int64()))],
                                         names=["word", "id", "nodes"])
    rows = S.trie_nodes(df, "word", [], "word string, id long, nodes array<long>", 9, emit).collect()
    assert [r.word for r in sorted(rows, key=lambda r: r.id)] == words
    node = {}
    for r in rows:
        assert len(r.nodes) == len(r.word) + 1
        for i, x in enumerate(r.nodes):
            assert node.setdefault(r.word[:i], x) == x
    assert len(set(node.values())) == len(node)
