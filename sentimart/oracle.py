"""DuckDB SQL for the correctness check of the registered queries.

Each builder returns SQL that DuckDB runs over the driver's tables
(``documents``, ``events`` ... registered as views). The SQL derives the
same post fields as ``sources.fixture`` directly from ``documents`` and
scores texts with the same rules as ``operators.score``, written
independently as list functions, a lateral ``range`` and joins.
"""

from __future__ import annotations

# Written out here, not imported: a wrong value in the package must not match
# itself. The test lexicon and modifiers of FIXTURES.md and the
# constants of the scoring method.
STATS_DECIMALS = 6
PUNCT = r"[!-/:-@\[-`{-~]"
CAPS, NEGATION, DAMP_2, DAMP_3 = 0.733, -0.74, 0.95, 0.9
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAIM, EXCLAIM_MAX, QUESTION, QUESTION_MAX = 0.292, 4, 0.18, 0.96
ALPHA = 15.0
LEXICON = [
    ("trash", -2.0), ("scum", -3.0), ("clown", -1.0), ("idiot", -3.0), ("worthless", -2.0),
    ("moron", -3.0), ("pathetic", -2.0), ("loser", -2.0), ("disgusting", -3.0), ("stupid", -2.0),
    ("the", 1.1), ("that", 0.8), ("of", -1.3), ("and", -0.7), ("to", 0.9), ("it", -1.0),
    ("for", 1.4), ("this", -1.6)]
BOOSTERS = [("is", 0.293), ("was", 0.293)]
NEGATIONS = ["with", "by", "never"]
NEAR_NEGATIONS = ["least"]
# several words: booster scalar, factor
PAIRS = [("kind of", -0.293, 1.0), ("never so", 0.0, 1.25), ("at least", 0.0, 1.0)]
# clauses that rule_bodies appends, by doc_id % 12
CLAUSES = [" but this is it", " isn't that for", " the that??", " the that???", " the that?????",
           " IS the", " kind of the", " never so the", " least the", " at least the", " THE that",
           " was this!!"]


# of the key with phrases: further entries of up to five words, idioms with
# their valence, emoji with their words, and the clauses by doc_id % 14
PHRASES = [("by no means", 0.0, -0.5), ("in the end of it", 0.4, 1.0), ("this is at least", -0.2, 1.1),
           ("never so", 0.0, 1.25)]
IDIOMS = [("kiss of the clown", -1.5), ("the that", 2.2), ("is it the that", -0.9), ("cut the", 2.0)]
EMOJI = [("\U0001F600", "that grin"), ("\U0001F600\u200D\u2744", "cold trash"), ("\u2639", "scum")]
PHRASE_CLAUSES = [
    " by no means the", " in the end of it the", " in the end of it so the", " this is at least trash",
    " never so at least the", " kiss of the clown!", " very KISS of the clown with it", " of the that of",
    " with is it the that but cut the", " kind of cut the", " good\U0001F600bad",
    " with \U0001F600\u200D\u2744\U0001F600 the", " \u2639\u2639 by the", " by no the that means"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _f(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def words_sql() -> str:
    """Word table: token, valence (NULL for boosters), in_lexicon, boost,
    negation, near."""
    lex = ", ".join(f"({_q(t)}, {_f(v)})" for t, v in LEXICON)
    mods = ", ".join([f"({_q(t)}, 'booster', {_f(s)})" for t, s in BOOSTERS]
                     + [f"({_q(t)}, 'negation', {_f(0)})" for t in NEGATIONS]
                     + [f"({_q(t)}, 'near', {_f(0)})" for t in NEAR_NEGATIONS])
    return f"""
    SELECT coalesce(l.token, m.token) AS token,
           CASE WHEN m.boost IS NULL THEN l.valence END AS valence,
           l.valence IS NOT NULL AS in_lexicon,
           m.boost AS boost,
           coalesce(m.negation, false) AS negation, coalesce(m.near, false) AS near
    FROM (SELECT token, max(valence) AS valence FROM (VALUES {lex}) t(token, valence)
          GROUP BY token) l
    FULL OUTER JOIN
         (SELECT token, max(CASE WHEN kind = 'booster' THEN scalar END) AS boost,
                 bool_or(kind = 'negation') AS negation, bool_or(kind = 'near') AS near
          FROM (VALUES {mods}) t(token, kind, scalar) GROUP BY token) m
    ON l.token = m.token"""


def scorer_ctes(src: str, keep: list[str], prefix: str = "sc", entries=PAIRS, idioms=(),
                emoji=()) -> str:
    """CTEs ending in ``{prefix}_out(id, keep..., neg, neu, pos, vaderScore)``.

    ``src`` is a CTE name with columns ``id``, ``text`` and ``keep``.
    ``entries`` are modifiers of several words, ``idioms`` and ``emoji`` as above.
    """
    strip = f"'^{PUNCT}+|{PUNCT}+$'"
    keep_sel = "".join(f", {k}" for k in keep)
    keep_d = "".join(f", d.{k}" for k in keep)
    upper = r"(regexp_matches({0}, '\p{{Lu}}') AND NOT regexp_matches({0}, '\p{{Ll}}'))"

    def ctx(d: int, damp: float) -> str:
        """Valence after the token at distance d: booster, negation, pair."""
        s = f"""(CASE WHEN t.v < 0 THEN -coalesce(w.boost, 0.0::DOUBLE) ELSE coalesce(w.boost, 0.0::DOUBLE) END
          + CASE WHEN w.boost IS NOT NULL AND t.u{d} AND t.cap
                 THEN (CASE WHEN t.v > 0 THEN {_f(CAPS)} ELSE {_f(-CAPS)} END) ELSE 0.0::DOUBLE END)
          * {_f(damp)}"""
        near = "OR coalesce(w.near, false)" if d == 1 else ""
        covered = f"{d} <= t.n2" + (f" OR (t.n3 > 0 AND {d} <= t.n3 + 1)" if d > 1 else "")
        step = f"""CASE WHEN l{d} IS NOT NULL AND NOT coalesce(w.in_lexicon, false) AND NOT t.g{d}
             THEN (t.v + {s})
                  * (CASE WHEN (coalesce(w.negation, false) OR contains(l{d}, 'n''t') {near})
                               AND NOT ({covered})
                          THEN {_f(NEGATION)} ELSE {_f(1.0)} END)
             ELSE t.v END"""
        return step

    def after_pair(d: int) -> str:
        return f"""CASE WHEN f{d} IS NULL THEN v
             ELSE (v + CASE WHEN v < 0 THEN -b{d} ELSE b{d} END) * f{d} END"""

    pairs = ", ".join(f"({_q(t)}, {len(t.split())}, {_f(b)}, {_f(f)})" for t, b, f in entries)
    known = ", ".join(f"({_q(t)}, {len(t.split())}, {_f(v)})"
                      for t, v in idioms or [("no such idiom", 0.0)])
    sizes = sorted({len(t.split()) for t, *_ in [*entries, *idioms]})
    text = "coalesce(text, '')"
    for sign, read in sorted(emoji, key=lambda x: -len(x[0])):
        text = f"replace({text}, {_q(sign)}, {_q(' ' + read + ' ')})"
    rest = ("t.id, t.i, t.but, t.cap, t.l1, t.l2, t.l3, t.u1, t.u2, t.u3, t.f2, t.b2, t.f3, t.b3, "
            "t.n2, t.n3, t.g1, t.g2, t.g3")
    return f"""
{prefix}_words AS ({words_sql()}),
{prefix}_pairs AS (SELECT * FROM (VALUES {pairs}) t(token, n, boost, factor)),
{prefix}_known AS (SELECT * FROM (VALUES {known}) t(token, n, valence)),
{prefix}_tok AS (
  SELECT id{keep_sel}, coalesce(text, '') AS text,
         list_filter(string_split_regex({text}, '\\s+'), lambda x: x <> '') AS raw
  FROM {src}),
{prefix}_doc AS (
  SELECT id{keep_sel}, raw, len(raw) AS n_tok,
         list_transform(raw,
           lambda x: CASE WHEN length(regexp_replace(x, {strip}, '', 'g')) <= 2 THEN lower(x)
                     ELSE lower(regexp_replace(x, {strip}, '', 'g')) END) AS toks,
         len(list_filter(raw, lambda x: {upper.format('x')})) AS n_up,
         length(text) - length(replace(text, '!', '')) AS n_excl,
         length(text) - length(replace(text, '?', '')) AS n_q
  FROM {prefix}_tok),
{prefix}_run AS (
  SELECT id, p, n, list_aggregate(toks[p - n + 1:p], 'string_agg', ' ') AS token
  FROM (SELECT id, toks, unnest(range(1, n_tok + 1)) AS p FROM {prefix}_doc), (SELECT unnest({sizes}) AS n)
  WHERE p >= n),
{prefix}_mod AS (
  SELECT r.id, r.p, max(r.n) AS n, arg_max(m.boost, r.n) AS boost, arg_max(m.factor, r.n) AS factor
  FROM {prefix}_run r JOIN {prefix}_pairs m ON r.token = m.token GROUP BY r.id, r.p),
{prefix}_idi AS (
  SELECT r.id, r.p, max(r.n) AS n, arg_max(m.valence, r.n) AS valence
  FROM {prefix}_run r JOIN {prefix}_known m ON r.token = m.token GROUP BY r.id, r.p),
{prefix}_in AS (
  SELECT id, p, bool_or(inside) AS inside FROM (
    SELECT id, q AS p, q < last AS inside
    FROM (SELECT id, p AS last, unnest(range(p - n + 1, p + 1)) AS q FROM {prefix}_idi))
  GROUP BY id, p),
{prefix}_at AS (
  SELECT d.*, m.valence AS idiom, d.i - coalesce(m.n, 1) + 1 AS s
  FROM (SELECT id, raw, toks, n_up, n_tok, unnest(range(1, n_tok + 1)) AS i FROM {prefix}_doc) d
  LEFT JOIN {prefix}_idi m ON d.id = m.id AND d.i = m.p
  LEFT JOIN {prefix}_in g ON d.id = g.id AND d.i = g.p
  WHERE NOT coalesce(g.inside, false)),
{prefix}_pos AS (
  SELECT id, i, s, idiom, toks[i] AS lw, {upper.format('raw[i]')} AS up,
         CASE WHEN s > 1 THEN toks[s - 1] END AS l1,
         CASE WHEN s > 2 THEN toks[s - 2] END AS l2,
         CASE WHEN s > 3 THEN toks[s - 3] END AS l3,
         coalesce(s > 1 AND {upper.format('raw[s - 1]')}, false) AS u1,
         coalesce(s > 2 AND {upper.format('raw[s - 2]')}, false) AS u2,
         coalesce(s > 3 AND {upper.format('raw[s - 3]')}, false) AS u3,
         (n_up > 0 AND n_up < n_tok) AS cap, coalesce(list_position(toks, 'but'), 0) AS but
  FROM {prefix}_at),
{prefix}_v0 AS (
  SELECT t.*, p2.factor AS f2, p2.boost AS b2, coalesce(p2.n, 0) AS n2,
         CASE WHEN coalesce(p2.n, 0) <= p3.n THEN p3.factor END AS f3,
         CASE WHEN coalesce(p2.n, 0) <= p3.n THEN p3.boost END AS b3,
         CASE WHEN coalesce(p2.n, 0) <= p3.n THEN p3.n ELSE 0 END AS n3,
         g1.id IS NOT NULL AS g1, g2.id IS NOT NULL AS g2, g3.id IS NOT NULL AS g3,
         CASE WHEN t.up AND t.cap
              THEN (CASE WHEN coalesce(t.idiom, w0.valence) > 0 THEN coalesce(t.idiom, w0.valence) + {_f(CAPS)}
                         ELSE coalesce(t.idiom, w0.valence) - {_f(CAPS)} END)
              ELSE coalesce(t.idiom, w0.valence) END AS v
  FROM {prefix}_pos t LEFT JOIN {prefix}_words w0 ON t.lw = w0.token
  LEFT JOIN {prefix}_mod p2 ON t.id = p2.id AND t.s - 1 = p2.p
  LEFT JOIN {prefix}_mod p3 ON t.id = p3.id AND t.s - 2 = p3.p
  LEFT JOIN {prefix}_in g1 ON t.id = g1.id AND t.s - 1 = g1.p
  LEFT JOIN {prefix}_in g2 ON t.id = g2.id AND t.s - 2 = g2.p
  LEFT JOIN {prefix}_in g3 ON t.id = g3.id AND t.s - 3 = g3.p
  WHERE coalesce(t.idiom, w0.valence) IS NOT NULL),
{prefix}_v1 AS (
  SELECT {rest}, {ctx(1, 1.0)} AS v
  FROM {prefix}_v0 t LEFT JOIN {prefix}_words w ON t.l1 = w.token),
{prefix}_v2a AS (
  SELECT {rest}, {ctx(2, DAMP_2)} AS v
  FROM {prefix}_v1 t LEFT JOIN {prefix}_words w ON t.l2 = w.token),
{prefix}_v2 AS (SELECT * EXCLUDE (v), {after_pair(2)} AS v FROM {prefix}_v2a),
{prefix}_v3a AS (
  SELECT {rest}, {ctx(3, DAMP_3)} AS v
  FROM {prefix}_v2 t LEFT JOIN {prefix}_words w ON t.l3 = w.token),
{prefix}_v3 AS (SELECT * EXCLUDE (v), {after_pair(3)} AS v FROM {prefix}_v3a),
{prefix}_val AS (
  SELECT id, CAST(CASE WHEN but > 0 AND i < but THEN v * {_f(BUT_BEFORE)}
                       WHEN but > 0 AND i > but THEN v * {_f(BUT_AFTER)}
                       ELSE v END AS DECIMAL(24,12)) AS vd
  FROM {prefix}_v3),
{prefix}_agg AS (
  SELECT id, sum(vd) AS s,
         sum(CASE WHEN vd > 0 THEN vd + 1 END) AS ps,
         sum(CASE WHEN vd < 0 THEN vd - 1 END) AS ns,
         count(CASE WHEN vd > 0 THEN 1 END) AS np,
         count(CASE WHEN vd < 0 THEN 1 END) AS nn
  FROM {prefix}_val GROUP BY id),
{prefix}_pre AS (
  SELECT d.id{keep_d}, d.n_tok,
         least(d.n_excl, {EXCLAIM_MAX}) * {_f(EXCLAIM)}
           + CASE WHEN d.n_q <= 1 THEN 0.0::DOUBLE
                  WHEN d.n_q <= 3 THEN d.n_q * {_f(QUESTION)}
                  ELSE {_f(QUESTION_MAX)} END AS emph,
         coalesce(CAST(a.s AS DOUBLE), 0.0::DOUBLE) AS s,
         coalesce(CAST(a.ps AS DOUBLE), 0.0::DOUBLE) AS ps,
         coalesce(CAST(a.ns AS DOUBLE), 0.0::DOUBLE) AS ns,
         CAST(d.n_tok - coalesce(a.np, 0) - coalesce(a.nn, 0) AS DOUBLE) AS neu
  FROM {prefix}_doc d LEFT JOIN {prefix}_agg a ON d.id = a.id),
{prefix}_emph AS (
  SELECT *,
         CASE WHEN s > 0 THEN s + emph WHEN s < 0 THEN s - emph ELSE s END AS s2,
         CASE WHEN ps > abs(ns) THEN ps + emph ELSE ps END AS ps2,
         CASE WHEN ps < abs(ns) THEN ns - emph ELSE ns END AS ns2
  FROM {prefix}_pre),
{prefix}_out AS (
  SELECT id{keep_sel},
         CASE WHEN n_tok = 0 THEN 0.0::DOUBLE ELSE round(abs(ns2 / (ps2 + abs(ns2) + neu)), 3) END AS neg,
         CASE WHEN n_tok = 0 THEN 0.0::DOUBLE ELSE round(abs(neu / (ps2 + abs(ns2) + neu)), 3) END AS neu,
         CASE WHEN n_tok = 0 THEN 0.0::DOUBLE ELSE round(abs(ps2 / (ps2 + abs(ns2) + neu)), 3) END AS pos,
         round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s2 / sqrt(s2 * s2 + {_f(ALPHA)}))), 4)
           AS vaderScore
  FROM {prefix}_emph)"""


def rule_bodies_sql(clauses=CLAUSES) -> str:
    """Whole texts with a clause that fires one rule each."""
    return ("SELECT doc_id AS id, text || (["
            + ", ".join(_q(c) for c in clauses)
            + f"])[CAST(doc_id % {len(clauses)} AS INTEGER) + 1] AS text FROM documents")


# --- fixture posts ---------------------------------------------------------

def posts_sql(kind: str = "chicago") -> str:
    """All posts (every language) with the display strings of tags/values."""
    def rules(pre: str) -> str:
        return f"""CASE WHEN doc_id % 97 = 0 THEN NULL
                 WHEN doc_id % 89 = 0 THEN '[]'
                 WHEN doc_id % 7 = 0
                   THEN '[{pre}' || source || ', {pre}src' || CAST((doc_id + 1) % 20 AS VARCHAR) || ']'
                 ELSE '[{pre}' || source || ']' END"""
    return f"""
  SELECT doc_id AS id, text AS body,
         {rules('')} AS tag,
         {rules('q ')} AS value,
         strftime(DATE '2024-01-01' + CAST((doc_id // 20) % 30 AS INTEGER), '%Y-%m-%d')
           || 'T12:00:00.000Z' AS postedTime,
         doc_id % 7 AS retweetCount,
         lang AS twitter_lang,
         'chicago_' || CAST(doc_id % 3 AS VARCHAR) AS folder,
         source
  FROM documents"""


def clean_sql(kind: str = "chicago") -> str:
    """Cleaned English posts: id, body, movieName, other, date, folder."""
    movie, other = ("tag", "value") if kind == "chicago" else ("value", "tag")
    return f"""
  SELECT id, body, {movie} AS movieName, {other} AS {'searchPattern' if kind == 'chicago' else 'tag'},
         postedTime, retweetCount, twitter_lang,
         CAST(left(postedTime, 10) AS DATE) AS date, folder
  FROM posts
  WHERE twitter_lang = 'en' AND tag IS NOT NULL AND body IS NOT NULL
        AND postedTime IS NOT NULL AND retweetCount IS NOT NULL"""


def class_case(col: str, splits: list[float]) -> str:
    parts = [f"WHEN {col} < {_f(u)} THEN {_f(k)}" for k, u in enumerate(splits[1:-1])]
    return f"CASE WHEN {col} IS NULL THEN NULL {' '.join(parts)} ELSE {_f(len(splits) - 2)} END"


def classified_ctes(kind: str = "chicago", splits: list[float] | None = None,
                    extra: list[str] | None = None) -> str:
    """posts, clean, scorer CTEs and ``cls(id, movieName, date, [extra], vaderScore, vaderClassifier)``."""
    splits = splits or [-1.0, -0.5, 0.5, 1.0]
    extra = list(extra or [])
    keep = ["movieName", "date", *extra]
    return f"""posts AS ({posts_sql(kind)}),
clean AS ({clean_sql(kind)}),
sc_src AS (SELECT id, body AS text, {', '.join(keep)} FROM clean),
{scorer_ctes('sc_src', keep)},
cls AS (SELECT *, {class_case('vaderScore', splits)} AS vaderClassifier FROM sc_out)"""


def movies_found_sql(src: str = "clean", keys: list[str] | None = None) -> str:
    k = "".join(f"{c}, " for c in (keys or []))
    return f"""SELECT DISTINCT {k}substr(movieName, 2, length(movieName) - 2) AS name
  FROM {src} WHERE movieName NOT LIKE '%,%' AND length(movieName) > 2"""


def exact_avg_sql(x: str, scale: int = 4) -> str:
    """Mean rounded half-up to STATS_DECIMALS with integer arithmetic."""
    m = 10 ** scale
    up = 10 ** (STATS_DECIMALS - scale)
    S = f"sum(CAST(round({x} * {m}) AS HUGEINT))"
    n = f"count({x})"
    return (f"CASE WHEN {n} = 0 THEN NULL ELSE CAST(sign({S}) * ((abs({S}) * {2 * up} + {n}) // (2 * {n}))"
            f" AS DOUBLE) / {float(10 ** STATS_DECIMALS)!r} END")


def stats_select(score: str = "s.vaderScore") -> str:
    d = STATS_DECIMALS
    return (f"{exact_avg_sql(score)} AS avgScore, round(stddev_samp({score}), {d}) AS stdDev, "
            f"min({score}) AS minScore, max({score}) AS maxScore, count({score}) AS totalTweets")
