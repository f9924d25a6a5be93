"""URL cascade, language-model scores and embeddings against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentimart.llm import embed, graph, lm, urls
from sentimart.llm.common import table
from llm_helpers import SF, components, documents, odd_rows


# --- urls -----------------------------------------------------------------------

def test_cascade_is_exact(spark):
    keys = [f"key{i}" for i in range(4000)]
    for listed in (keys[:1], keys[::7], keys[:3900], [], keys[:5] + ["not in the corpus"]):
        names = spark.createDataFrame([(k,) for k in listed], "key string")
        universe = spark.createDataFrame([(k,) for k in keys], "key string")
        levels = urls.build_cascade(names, universe)
        got = {r.key for r in universe.where(urls.member(levels, F.col("key"))).collect()}
        assert got == set(listed) & set(keys)


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h), len(p), h + p, a) for a, h, p in rules
            if ("." + host).endswith("." + h) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls(spark):
    cases = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "http://xnet/",
             "http://net/x?y#z", "ftp://EXAMPLE.net/en/a", "http://example.net/en",
             "http://a.example.net/en/?q=/en/", "http://badexample.net/en/", "https://É.org/fr/ü",
             "http://org?x=/fr/", "http://example.com/de/x://y/", "a://b://example.net/",
             "http://u@x.example.com:80/de/", "http://x.example.com/de/", "http://a..net/b",
             "x\ny://new.net/\n", "http://" + "a." * 500 + "net/" + "p" * 5000]
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(cases)] + [(3, cases[5], "h", "p", "r"),
                                                                  (None, cases[5], "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, key string")
    extra = [*urls.RULES, ("allow", "a.net", "/"), ("block", "example.net", "/en/a"),
             ("block", "org", "/f")]
    for rules in (urls.RULES, extra, []):
        got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict)
                      for r in urls.judge(pages, rules).collect())
        assert got == Counter((i, *brute_url(u, rules)) for i, u, *_ in rows)
    assert urls.judge(pages.limit(0)).count() == 0


def test_very_long_hosts_and_a_table_of_rules(spark):
    """Work per url follows the rules' label counts, not the host's."""
    import time

    long = "http://" + "a." * 100_000 + "example.net/en/x"
    rows = [(1, long), (2, "http://" + "." * 50_000 + "net/"), (3, "http://b.org/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    table = spark.createDataFrame([*urls.RULES, ("block", "b.org", "/fr/"), (None, "c", "/"),
                                   ("block", None, "/")], "action string, host string, path string")
    urls.judge(pages.where("page_id = 3"), table).collect()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(pages, table).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: ("b.org/fr/", "block")}
    assert time.time() - began < 30   # a second or two of work; the rest is a busy machine


# --- language model ---------------------------------------------------------------

def brute_lm(rows, enc, order=2):
    """Every document's results; rows without an id are documents of their own."""
    docs, start = {}, object()
    for k, (i, t) in enumerate(rows):
        docs.setdefault(("none", k) if i is None else i, []).append(t)
    grams = {o: Counter() for o in range(2, order + 1)}
    words, mine = Counter(), {}
    for i, texts in docs.items():
        mine[i] = {o: Counter() for o in grams}
        for t in texts:
            ids = [start] * (order - 1) + enc.encode_ordinary(t or "")
            for at in range(order - 1, len(ids)):
                words[ids[at]] += 1
                for o in grams:
                    mine[i][o][tuple(ids[at - o + 1:at + 1])] += 1
        for o in grams:
            grams[o].update(mine[i][o])

    def contexts(of):
        out = {o: Counter() for o in of}
        for o in of:
            for g, n in of[o].items():
                out[o][g[:-1]] += n
        return out

    context, total, out = contexts(grams), sum(words.values()), {}
    for i, own in mine.items():
        own_context = contexts(own)
        s = n = back = 0
        for g, k in own[order].items():
            n += k
            for o in range(order, 0, -1):
                if o == 1:
                    s += k * math.log(lm.BACKOFF ** (order - 1) * words[g[-1]] / total)
                    break
                x = g[-o:]
                c = grams[o][x] - own[o][x]
                if c > 0:
                    d = context[o][x[:-1]] - own_context[o][x[:-1]]
                    s += k * math.log(lm.BACKOFF ** (order - o) * c / d)
                    break
                back += k * (o == order)
        out[i] = (n, back, s)
    return out


def same_scores(got, want):
    assert len(got) == len(want)
    named = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(named) == sum(r.doc_id is not None for r in got)
    for i, (n, back, s) in want.items():
        if not isinstance(i, tuple):
            assert (named[i].n_tokens, named[i].n_backoff) == (n, back)
            assert named[i].log_score == pytest.approx(s, abs=1e-6)
            assert named[i].mean_log_score == (pytest.approx(s / n) if n else None)
    left = sorted((r.n_tokens, r.n_backoff, r.log_score) for r in got if r.doc_id is None)
    for x, y in zip(left, sorted(v for i, v in want.items() if isinstance(i, tuple))):
        assert x == pytest.approx(y, abs=1e-6)


def several_rows():
    """Ids of several rows, rows without an id, a gram that every text holds."""
    rows = odd_rows() + [(50 + i, f"the only pair {'again and again ' * (i % 3)}of {i}") for i in range(30)]
    rows += [(50, "the only pair once more"), (50, "of 50"), (51, ""), (51, None)]
    return rows + [(None, "the only pair once more"), (None, "the only pair once more"), (None, "")]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("frequent", [0, 7, lm.FREQUENT])
def test_scores_of_any_order(spark, tokenizer, shared, order, frequent):
    """Frequent grams scored in place or not, repeated ids, a common gram."""
    rows = several_rows()
    got = lm.score(documents(spark, rows).repartition(5), shared, tokenizer[1], order=order,
                   frequent=frequent).collect()
    same_scores(got, brute_lm(rows, tokenizer[2], order))


def test_equal_rows_of_one_id_see_nothing_of_each_other(spark, tokenizer, shared):
    rows = [(1, "ten words that nothing else in this table holds"), (2, "x")]
    both = lm.score(documents(spark, rows + rows[:1]), shared, tokenizer[1]).collect()
    one = next(r for r in both if r.doc_id == 1)
    assert one.n_backoff == one.n_tokens > 0


def test_an_order_beyond_the_bits_is_refused(tokenizer):
    assert lm.symbol_bits(tokenizer[0], 3)[1] == 16
    with pytest.raises(ValueError, match="do not fit"):
        lm.symbol_bits(tokenizer[0], 4)
    assert lm.symbol_bits({b"a": 0, b"b": 70_000}, 3) == (70_001, 17)   # more than 16 bits of ids


@pytest.mark.parametrize("odd", [False, True])
def test_scores(spark, tokenizer, shared, odd):
    docs = documents(spark, odd_rows()) if odd else table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    same_scores(lm.score(docs, shared, tokenizer[1]).collect(), brute_lm(rows, tokenizer[2]))
    assert lm.score(docs.limit(0), shared, tokenizer[1]).count() == 0


# --- embeddings -------------------------------------------------------------------

def brute_links(rows, threshold=0.95):
    ok = []
    for k, (_, x) in enumerate(rows):
        good = x is not None and len(x) and all(e is not None and math.isfinite(e) for e in x) \
            and any(x)
        if good:
            a = np.array(x, np.float64)
            a = a / np.abs(a).max()
            ok.append((k, a / np.linalg.norm(a)))
    links = []
    for p, (i, a) in enumerate(ok):
        links += [(i, j) for j, b in ok[:p] if len(a) == len(b) and a @ b >= threshold]
    return links


def compare(spark, rows, kind="array<float>"):
    df = spark.createDataFrame([(i, x, 0, 1) for i, x in rows],
                               f"vec_id long, embedding {kind}, label int, n_links int")
    got = embed.near_duplicates(df).collect()
    return df, got


def test_embeddings_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    got = {r.vec_id: r for r in embed.near_duplicates(table(spark, sf, "embeddings")).collect()}
    links = [(rows[a][0], rows[b][0]) for a, b in brute_links(rows)]
    n = Counter(x for e in links for x in e)
    comp = components([i for i, _ in rows], links)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


@pytest.mark.parametrize("max_words", [1024, 24])      # two blocks, three blocks
def test_recall_at_the_threshold(spark, max_words):
    """Pairs with cosine 0.95 to 0.96, the hardest: all of some hundreds."""
    assert embed.code_shape(3000, embed.PER_CODE, max_words)[1] == (2 if max_words > 100 else 3)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(1500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9501 + 0.01 * rng.random()
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed.near_duplicates(df, max_words=max_words).collect()
    assert 0.995 * 1500 <= sum(r.n_links for r in got) / 2 <= 1500


def test_code_shape_is_bounded():
    """The words of a block stay bounded; directions follow the vectors."""
    for count in (1, 10, 10 ** 5, 10 ** 7, 10 ** 10, 10 ** 12):
        words, blocks = embed.code_shape(count, embed.PER_CODE, embed.MAX_WORDS)
        assert words <= embed.MAX_WORDS and embed.CODES * blocks * words ** blocks < 2 ** 63
        assert words ** blocks >= 0.9 * count * embed.PER_CODE


def test_decoding_lists_every_direction_above_the_bound():
    rng = np.random.default_rng(1)
    code = embed.ProductCode(9, 5, 3, 0)
    x = rng.normal(size=(20, 9))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code.bound = 0.3
    a, b, c = code.products(x)
    whole = (a[:, :, None, None] + b[:, None, :, None] + c[:, None, None, :]).reshape(20, -1)
    for got, row in zip(code.filters(x), whole):
        assert sorted(got) == np.flatnonzero(row > 0.3).tolist()


def test_links_of_near_copies_are_not_written_out(spark):
    """A group of near copies leaves the verifying step as one row per vector
    and group it meets in, not as one per link, and each link counts once."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=32)
    x = [(base + rng.normal(size=32) * 0.01).tolist() for _ in range(400)]
    vectors = spark.createDataFrame([(i, 1 + i % 3, e) for i, e in enumerate(x)],
                                    "v long, n long, x array<double>")
    rows = embed.vector_links(vectors).collect()
    assert len(rows) <= 400 * 12 * 40 and {r.root for r in rows} >= {0}
    others = Counter()
    for r in rows:
        others[r.v] += r.others
    total = sum(1 + i % 3 for i in range(400))
    assert others == {i: total - (1 + i % 3) for i in range(400)}


def test_many_lengths_in_one_plan(spark):
    """Vectors of 40 lengths: each links within its own."""
    rng = np.random.default_rng(5)
    rows = []
    for dim in range(1, 41):
        x = rng.normal(size=dim)
        rows += [(3 * dim, x.tolist()), (3 * dim + 1, (2 * x).tolist()),
                 (3 * dim + 2, (-x).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(df).collect()}
    assert got == {i: (0, i) if i % 3 == 2 else (1, i - i % 3) for i, _ in rows}


def test_a_star_is_spread_over_salts(spark):
    """Components of a star of 10,000 links, a chain and a pair; the rows of
    one centre are dealt over many (key, salt) pairs."""
    edges = ([(i, 0) for i in range(1, 10_001)] + [(i, i + 1) for i in range(20_000, 20_040)]
             + [(50_000, 49_999), (7, 7)])
    links = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.label for r in graph.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(10_001)}, **{i: 20_000 for i in range(20_000, 20_041)},
                   50_000: 49_999, 49_999: 49_999}
    star = links.select(F.col("b").alias("k"), F.col("a").alias("x"))
    least = graph.with_least(star, "k", "x", "x")
    assert least.count() == len(edges)
    assert least.where("k = 0").agg(F.min("least"), F.max("least")).first() == (1, 1)
    plan = least._jdf.queryExecution().optimizedPlan().toString()
    assert "_x_salt" in plan


def test_crowded_filters_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", 8)     # many chunks per filter
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + rng.gauss(0, 0.12) for x in base]) for i in range(120)]
    rows += [(200 + i, [1.0] * 16) for i in range(60)]                  # one common vector
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16),
             (304, [None] * 16), (305, [float("inf")] + [1.0] * 15), (306, [2.0] * 16),
             (307, [1.0, 0.0]), (308, [1.0, -0.0]), (None, [1.0] * 16), (309, [1e-30] * 16),
             (310, [5.0])]
    # floats, as the table stores them
    rows = [(i, x and [e if e is None else float(np.float32(e)) for e in x]) for i, x in rows]
    df, got = compare(spark, rows)
    links = brute_links(rows)
    n = Counter(x for e in links for x in e)
    want = Counter((rows[k][0], n[k]) for k in range(len(rows)))
    assert Counter((r.vec_id, r.n_links) for r in got) == want
    comp = components(range(len(rows)), links)
    least = defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(least[comp[k]], math.inf if i is None else i)
    for k, (i, _) in enumerate(rows):
        r = next(r for r in got if r.vec_id == i)
        assert r.component_id == (None if i is None else least[comp[k]])
        assert r.kept == (i is not None and i == least[comp[k]])
    assert embed.near_duplicates(df.limit(0)).count() == 0
