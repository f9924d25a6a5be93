"""The driver contract and a DuckDB check of a few keys on sf0.001."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from sf_paths import SF_SMALL

KEYS = ["score_rules", "empty_files", "describe_frame", "run_all", "folder_daily_listed",
        "chunk_daily", "score_compound", "movie_counts", "movie_stats", "daily_sentiment", "score_all", "unique_movies",
        "movie_chunks", "folder_daily", "lenient_date", "counts_wide"]


def test_contract(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    # every query of the reference's operators has SQL
    assert {k for k in set(qs) - set(sql) if k != "pipeline" and not k.startswith("op")} == set()
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == E.entry(spark).columns


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(E.oracle_sql()[key])
    idx = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(rel.columns) == cols
    exp = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert got == exp


def test_every_rule_of_the_scorer_is_met():
    """Posts hit per rule in the bodies that score_rules scores, by DuckDB."""
    from sentimart import oracle as O
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    rel = con.sql(f"""WITH bodies AS ({O.rule_bodies_sql()}), {O.scorer_ctes('bodies', [])}
      SELECT count(CASE WHEN list_contains(toks, 'but') THEN 1 END) AS n_but,
             count(CASE WHEN n_q = 2 THEN 1 END) AS n_q2, count(CASE WHEN n_q = 3 THEN 1 END) AS n_q3,
             count(CASE WHEN n_q > 3 THEN 1 END) AS n_q5, count(CASE WHEN n_excl > 0 THEN 1 END) AS n_ex,
             (SELECT count(*) FROM sc_v0 WHERE contains(l1, 'n''t') OR contains(l2, 'n''t')) AS n_not,
             (SELECT count(*) FROM sc_v0 WHERE u1 AND cap AND l1 = 'is') AS n_caps_boost,
             (SELECT count(*) FROM sc_v0 WHERE up AND cap) AS n_caps,
             (SELECT count(*) FROM sc_v0 WHERE b2 < 0) AS n_kind,
             (SELECT count(*) FROM sc_v0 WHERE f2 = 1.25) AS n_never,
             (SELECT count(*) FROM sc_v0 WHERE l1 = 'least' AND f2 IS NULL) AS n_least,
             (SELECT count(*) FROM sc_v0 WHERE l1 = 'least' AND f2 = 1) AS n_at_least
      FROM sc_doc""")
    hits = dict(zip(rel.columns, rel.fetchall()[0]))
    assert all(n > 0 for n in hits.values()), hits


def test_no_query_plan_has_nested_loops_or_python(spark):
    bad = {}
    mine = {k: f for k, f in E.queries().items() if k != "pipeline" and not k.startswith("op")}
    for key, fn in mine.items():
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        hits = [w for w in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
                            "ArrowEvalPython") if w in plan]
        if hits:
            bad[key] = hits
    assert bad == {}


@pytest.mark.parametrize("absent", ["xxhash", "sentimart.llm", "corpus_pipeline"])
def test_entry_without_the_corpus_operators_or_their_libraries(absent):
    """The other queries stay when that part can't be imported."""
    import subprocess
    import sys

    code = (f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as E; "
            "print(len(E.queries()), sum(k.startswith('op') for k in E.queries()))")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=E.__file__.rsplit("/", 1)[0])
    n, corpus = map(int, out.stdout.split())
    assert n >= 54 and corpus == 0, out.stderr
