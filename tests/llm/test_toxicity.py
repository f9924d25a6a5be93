"""Toxicity: restoring against brute force, held-out accuracy, odd rows."""

import itertools
import math
import random
import re

import duckdb
import pytest

from llm_helpers import SF, documents, odd_rows
from sentimart.llm import toxicity as T

BIG = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    return T.letter_model(T.letter_counts(docs)).tolist()


def test_letter_counts_equal_a_plain_count(spark):
    rows = [(1, "The tree"), (2, None), (3, ""), (4, "ÀÉ÷ß a1b 漢字"), (5, "x" * 50)]
    exp = {}
    index = lambda c: (ord(c) - 96 if "a" <= c <= "z" else
                       ord(c) - 0xDF + 27 if "ß" <= c <= "ÿ" and c != "÷" else 0)
    for text in (f"  {t.lower()}  " for _, t in rows if t):
        for a, b, c in zip(text, text[1:], text[2:]):
            k = (index(a) * 60 + index(b)) * 60 + index(c)
            exp[k] = exp.get(k, 0) + 1
    for parts in (1, 3):
        got = T.letter_counts(documents(spark, rows).repartition(parts)).collect()
        assert {r.code: r.n for r in got if r.code} == {k: n for k, n in exp.items() if k}


def test_letter_model_is_a_distribution(model):
    for a, b in ((0, 0), (20, 8), (1, 59)):
        assert math.isclose(sum(math.exp(-c) for c in model[a][b]), 1, rel_tol=1e-9)


def cheapest(choices, model):
    """The reading of least cost, over all readings."""
    best = math.inf, ""
    for way in itertools.product(*choices):
        cost, a, b, out = 0.0, 0, 0, ""
        for c, channel in [*way, (" ", 0.0)]:
            cost += channel
            if c and not (c == " " and not b):
                k = T._index(c)
                cost, a, b, out = cost + model[a][b][k], b, k, out + c
        best = min(best, (cost, out.strip()))
    return best[1]


def test_viterbi_finds_the_cheapest_reading(model):
    rnd = random.Random(2)
    for _ in range(150):
        token = "".join(rnd.choice("thein1034@$!.-sao ") for _ in range(rnd.randrange(1, 8)))
        choices = T.lattice(token)
        assert T.viterbi(choices, model) == cheapest(choices, model)


WORDS = ["idiot", "moron", "trash", "stupid", "pathetic", "worthless", "disgusting", "clown", "loser"]


def disguised(w):
    leet = w.translate(str.maketrans("oieas", "0134$"))
    return {"leet": leet, "apart": " ".join(w), "dots": ".".join(w), "dashes": "-".join(w),
            "long": w[0] + w[1] * 5 + w[2:], "loud": w.upper() + "!!!", "mixed": " ".join(leet)}


def test_disguised_words_read_as_the_words(model):
    """Those in the corpus the language model knows: nine in ten, whatever the disguise."""
    for kind in disguised("idiot"):
        read = [w for w in WORDS
                if any(w in T.restore(t, model) for t in T.tokens(f"and {disguised(w)[kind]} the"))]
        assert len(read) >= 8, (kind, read)


def test_plain_words_stay(model):
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 50").fetchall()]
    for t in {w for x in texts for w in T.tokens(x)}:
        if re.fullmatch(r"[^\W\d_]+[.,]?", t) and not re.search(r"(.)\1\1", t):
            assert T.restore(t, model) == (t.rstrip(".,"),)


def scored(spark, sf):
    from sentimart.llm.queries import QUERIES
    rows = QUERIES["op12_toxicity"](spark, sf).collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    return rows, labels


def test_held_out_rows(spark):
    """Labels that were not learnt from, on the largest table at hand."""
    sf = SF.replace("0.001", "0.1")
    rows, labels = scored(spark, sf)
    n = duckdb.sql(f"SELECT count(*) FROM '{sf}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = ([s for s, y in held if y == k] for k in (1, 0))
    assert len(toxic) > 50 and len(clean) > 500
    assert sum(s >= 0.5 for s in toxic) / len(toxic) >= 0.9
    assert sum(s >= 0.5 for s in clean) / len(clean) <= 0.01
    better = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert better >= 0.97


def labelled(spark, n=400):
    """Toxic texts hold a word, disguised in the held-out rows alone."""
    rnd, rows, labels = random.Random(5), [], []
    import zlib
    plain = "the and that with this from have they will your about there".split()
    for i in range(n):
        held, toxic = zlib.crc32(str(i).encode()) % 5 == 0, i % 3 == 0
        words = [rnd.choice(plain) for _ in range(30)]
        if toxic:
            w = rnd.choice(WORDS[:4])
            words.insert(rnd.randrange(30), disguised(w)[rnd.choice(["leet", "apart", "dots", "long"])]
                         if held else w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_disguises_that_no_training_row_has(spark):
    rows, labels, of = labelled(spark)
    got = T.score(documents(spark, rows), labels).where("held_out").collect()
    toxic = [r for r in got if of[r.doc_id]]
    assert len(toxic) > 15 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert not any(r.predicted for r in got if not of[r.doc_id])


def test_odd_rows_repeats_and_clashing_columns(spark):
    rows, labels, _ = labelled(spark, 200)
    odd = [(None if i is None else i + 5000, t) for i, t in odd_rows()]
    labels = labels.unionByName(spark.createDataFrame(
        [(5001, None), (5002, 1), (5002, 0), (None, 1), (99999, 1)], "doc_id long, toxic int"))
    docs = documents(spark, rows + odd + [(None, "a\0\0\0b idiot"), (6000, "1" * 5000 + "a" * 5000)])
    got = T.score(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) + 2
    by = {}
    for r in got:
        assert 0 <= r.score <= 1
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.score for r in by[5006]}) == 1 and all(r.held_out for r in by[None])
    assert by[5001][0].score == by[5002][0].score == by[5003][0].score   # nothing to tell by
    again = {(r.doc_id, r.score) for r in T.score(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_without_labels_and_without_documents(spark):
    rows, labels, _ = labelled(spark, 40)
    none = labels.where("false")
    assert {round(r.score, 6) for r in T.score(documents(spark, rows), none).collect()} == {0.0}
    one = T.score(documents(spark, rows), labels.where("toxic = 0")).collect()
    assert {round(r.score, 6) for r in one} == {0.0}
    assert T.score(documents(spark, []), labels).count() == 0
