"""Rule-based lexicon sentiment scoring, one Arrow batch at a time.

Per text the scorer yields the compound score in [-1, 1] and the
proportions of negative, neutral and positive tokens. Rules (published
method, constants in ``ScorerParams``):

1. split on whitespace, strip surrounding ASCII punctuation unless 2 or fewer
   characters remain, look tokens up lower-cased;
2. caps: when some but not all tokens are upper case, an upper-case lexicon
   token moves ``caps_increment`` further from zero;
3. boosters among the 3 preceding tokens add their scalar towards the
   valence's sign (an upper-case booster under rule 2 adds
   ``caps_increment`` away from zero as well), damped at distance 2 and 3; a
   preceding token that is itself in the lexicon is not a modifier;
4. a negation among the 3 preceding tokens multiplies by ``negation_scalar``
   (once per hit); a near negation ("least") only right before the token;
   per distance 1, 2, 3: booster added, then negation;
5. several words in a row that are an entry ("kind of", "never so", "by no
   means at all"), the last at distance 1 or 2 (e): after step e + 1 the
   entry's booster scalar is added towards the sign and its factor multiplies;
   none of its words negates. Of entries with one last word the longest
   counts, and one that lies inside another does not;
   idioms: several words in a row with a valence of their own are scored like
   a word in the place of the last one, with the tokens before the first as
   context; what ends inside an idiom is not scored, and none of its words is a
   modifier. Emoji are read as the words of their description;
6. "but": valences before the first "but" x0.5, after it x1.5;
7. punctuation emphasis on the sum, away from zero ("!" and "?");
8. compound = round(s / sqrt(s^2 + alpha), 4), clipped to [-1, 1];
9. proportions: positive tokens give v+1, negative v-1, others 1; emphasis
   goes to the larger side; each divided by the total, rounded to 3.

Plan: the tokens of a text are all in one row, so nothing is shuffled,
sorted or exploded. A batch's tokens are looked up once per distinct token,
laid end to end as arrays, entries of several words are found by walking a trie
of the reversed entries back from all tokens at once, and rules 2-6 are array
operations over the lexicon hits; per text the sums come back as columns, and rules 7-9 are
plain Spark expressions over them. Valences are summed as integers of
10^-12, so a sum is exact (``good`` and an equal ``bad`` cancel to zero).
The word table goes to the tasks as a Python object, only within
``MAX_WORDS`` rows and ``MAX_WORD_BYTES``; a larger list is first cut to the
words that occur in the texts.
"""

from __future__ import annotations

import re
import string
import unicodedata
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentimart.functions.lexicon import DEFAULT_PARAMS, ScorerParams
from sentimart.functions.text import tokens


MAX_WORDS = 500_000
MAX_WORD_BYTES = 32 * 1024 * 1024
MAX_CACHED_TOKENS = 300_000
_SUMS = ["_s_tok", "_s_excl", "_s_q", "_s_sum", "_s_pos", "_s_neg", "_s_npos", "_s_nneg"]
_UNIT = 10 ** 12


@dataclass
class WordTable:
    """Lexicon and modifiers as dictionaries keyed by lower-case token."""

    valence: dict[str, float] = field(default_factory=dict)
    boost: dict[str, float] = field(default_factory=dict)
    negation: set[str] = field(default_factory=set)
    near: set[str] = field(default_factory=set)
    phrases: dict[tuple[str, ...], tuple[float, float]] = field(default_factory=dict)
    idioms: dict[tuple[str, ...], float] = field(default_factory=dict)
    emoji: dict[str, str] = field(default_factory=dict)

    def add_word(self, token: str, valence: float) -> None:
        """A word, or several in a row (an idiom)."""
        words = tuple(token.lower().split())
        if len(words) > 1:
            self.idioms[words] = max(valence, self.idioms.get(words, valence))
        else:
            token = token.lower()
            self.valence[token] = max(valence, self.valence.get(token, valence))

    def add_modifier(self, token: str, kind: str, scalar: float) -> None:
        """Entries that come twice: the larger scalar counts (of an emoji's
        descriptions the last in order)."""
        if kind == "emoji":
            sign, _, text = token.partition(" ")
            self.emoji[sign] = max(text.strip(), self.emoji.get(sign, ""))
            return
        words = tuple(token.lower().split())
        if len(words) > 1:
            boost, factor = self.phrases.get(words, (0.0, 1.0))
            if kind == "booster":
                boost = scalar if boost == 0.0 else max(boost, scalar)
            elif kind == "amplifier":
                factor = scalar if factor == 1.0 else max(factor, scalar)
            else:
                raise ValueError(f"a modifier of several words must be a booster or an amplifier: "
                                 f"{token!r}")
            self.phrases[words] = boost, factor
        elif not words:
            raise ValueError("a modifier without a word")
        elif kind == "booster":
            self.boost[words[0]] = max(scalar, self.boost.get(words[0], scalar))
        elif kind == "negation":
            self.negation.add(words[0])
        elif kind == "negation_near":
            self.near.add(words[0])
        else:
            raise ValueError(f"unknown kind {kind!r} of the one-word modifier {token!r}")


def _bounded_rows(df: DataFrame, max_rows: int, max_bytes: int) -> list | None:
    """All rows, or None when they pass a bound (reads at most one row more).
    A table of literals is answered without a job."""
    rows = df.limit(max_rows + 1).collect()
    size = sum(len(r[0].encode("utf-8")) for r in rows)
    return rows if len(rows) <= max_rows and size <= max_bytes else None


def word_table(lexicon: DataFrame, modifiers: DataFrame, texts: DataFrame, text_col: str,
               max_words: int = MAX_WORDS, max_bytes: int = MAX_WORD_BYTES) -> WordTable:
    """The word table for the tasks, within the bounds.

    A lexicon beyond them is cut to the words that occur in ``texts``: their
    distinct tokens (combined before the shuffle, so a frequent word is a few
    rows) semi-join the lexicon. If even those pass the bounds, it raises."""
    lex = lexicon.where(F.col("token").isNotNull() & F.col("valence").isNotNull()) \
                 .select("token", F.col("valence").cast("double"))
    rows = _bounded_rows(lex, max_words, max_bytes)
    if rows is None:
        rows = _bounded_rows(occurring(lex, texts, text_col, modifiers), max_words, max_bytes)
    mods = _bounded_rows(modifiers.where(F.col("token").isNotNull())
                         .select("token", "kind", F.col("scalar").cast("double")),
                         max_words, max_bytes)
    if rows is None or mods is None:
        raise ValueError(f"more than {max_words} words or {max_bytes} bytes of words occur in the "
                         "texts; raise max_words / max_bytes if the executors have the memory")
    table = WordTable()
    for token, valence in rows:
        table.add_word(token, valence)
    for token, kind, scalar in mods:
        table.add_modifier(token, kind, scalar)
    return table


def occurring(lexicon: DataFrame, texts: DataFrame, text_col: str,
              modifiers: DataFrame | None = None) -> DataFrame:
    """The rows of ``lexicon`` whose token (of an idiom the first word) occurs
    in the texts or in a description of an emoji."""
    split = texts.select(F.array_distinct(tokens(F.lower(F.col(text_col)))).alias("t"))
    if modifiers is not None:
        read = modifiers.where("kind = 'emoji'").select(F.split(F.lower("token"), " ").alias("t"))
        split = split.unionByName(read)
    seen = split.select(F.explode("t").alias("t")).distinct()
    first = F.element_at(F.split(F.trim(F.lower("token")), r"\s+"), 1)
    return lexicon.join(seen, first == F.col("t"), "left_semi")


class _Phrases:
    """Entries of several words, as a trie of the reversed entries."""

    def __init__(self, words: WordTable):
        entries = sorted({*words.phrases, *words.idioms})
        self.word = {w: i for i, w in enumerate(sorted({w for e in entries for w in e}), 1)}
        self.longest = max(map(len, entries), default=0)
        step, nodes = {}, [None]           # (node, word) to node; entry that ends at a node
        for e in entries:
            at = 0
            for w in reversed(e):
                key = at * (len(self.word) + 1) + self.word[w]
                if key not in step:
                    step[key] = len(nodes)
                    nodes.append(None)
                at = step[key]
            nodes[at] = e
        self.keys = np.array(sorted(step), np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], np.int64)
        mods = [words.phrases.get(e) for e in nodes]
        self.boost = np.array([m[0] if m else 0.0 for m in mods])
        self.factor = np.array([m[1] if m else np.nan for m in mods])
        self.valence = np.array([words.idioms.get(e, np.nan) for e in nodes])

    def ends(self, word: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
        """For every token, node and number of words of the longest modifier
        that ends there, and the same of the longest idiom (0: none)."""
        out = [np.zeros(len(word), np.int64) for _ in range(4)]
        if not len(self.keys):
            return tuple(out)
        at = np.flatnonzero(word)
        node = np.zeros(len(at), np.int64)
        for n in range(1, self.longest + 1):
            inside = pos[at] >= n - 1
            at, node = at[inside], node[inside]
            key = node * (len(self.word) + 1) + word[at - n + 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = (self.keys[place] == key) & (word[at - n + 1] > 0)
            at, node = at[met], self.next[place[met]]
            if not len(at):
                break
            for k, known in ((0, self.factor), (2, self.valence)):
                here = ~np.isnan(known[node])
                out[k][at[here]], out[k + 1][at[here]] = node[here], n
        return tuple(out)


class _Classes(dict):
    """Class of each raw token: tokens with equal properties share a class,
    so the property arrays stay as short as the word table."""

    def __init__(self, words: WordTable, params: ScorerParams):
        super().__init__()
        self.words, self.params = words, params
        self.trie = _Phrases(words)
        # the longest first: a sign with a modifier is one of its own
        signs = sorted(filter(None, words.emoji), key=lambda x: (-len(x), x))
        self.emoji = re.compile("|".join(map(re.escape, signs))) if signs else None
        self.rows: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.plain = self._class((np.nan, False, np.nan, False, False, False, False, 0))
        self.arrays: list[np.ndarray] = []

    def _class(self, row: tuple) -> int:
        key = tuple(None if x != x else x for x in row)
        k = self.number.setdefault(key, len(self.rows))
        if k == len(self.rows):
            self.rows.append(row)
        return k

    def __missing__(self, raw: str) -> int:
        bare = raw.strip(string.punctuation)
        low = (raw if len(bare) <= 2 else bare).lower()
        w = self.words
        boost = w.boost.get(low, np.nan)
        valence = w.valence.get(low, np.nan)
        kinds = {unicodedata.category(c) for c in raw}
        row = (valence if boost != boost else np.nan,    # a booster is never scored itself
               low in w.valence, boost,
               low in w.negation or self.params.negation_suffix in low, low in w.near,
               "Lu" in kinds and "Ll" not in kinds, low == self.params.but_token,
               self.trie.word.get(low, 0))
        if len(self) >= MAX_CACHED_TOKENS:
            self.clear()
        self[raw] = k = self._class(row)
        return k

    def read(self, text: str) -> str:
        """The text with its emoji as words."""
        if self.emoji is None or not self.emoji.search(text):
            return text
        return self.emoji.sub(lambda m: f" {self.words.emoji[m[0]]} ", text)

    def columns(self) -> list[np.ndarray]:
        """Property arrays by class: valence, in lexicon, boost, negation,
        near, upper, but, number among the words of phrases."""
        if not self.arrays or len(self.arrays[0]) != len(self.rows):
            self.arrays = [np.array(c) for c in zip(*self.rows)]
        return self.arrays


_find_tokens = re.compile(r"[^ \t\n\x0b\f\r]+").findall


def text_sums(texts: list, classes: _Classes, params: ScorerParams) -> list[np.ndarray]:
    """The columns of ``_SUMS`` for a list of texts (rules 1-6)."""
    split = [_find_tokens(classes.read(t)) if t else [] for t in texts]
    n_tok = np.array([len(t) for t in split], np.int64)
    total = int(n_tok.sum())
    code = np.fromiter(map(classes.__getitem__, chain.from_iterable(split)), np.int64, total)
    valence, in_lex, boost, neg, near, upper, but, word = classes.columns()
    row = np.repeat(np.arange(len(texts)), n_tok)
    pos = np.arange(total) - (np.cumsum(n_tok) - n_tok)[row]
    n_up = np.bincount(row, weights=upper[code], minlength=len(texts))
    mixed = (n_up > 0) & (n_up < n_tok)
    but_at = np.full(len(texts), -1)
    b = np.flatnonzero(but[code])[::-1]
    but_at[row[b]] = pos[b]                      # reversed: the first one stays

    trie = classes.trie
    mod, mod_n, idiom, idiom_n = trie.ends(word[code], pos)
    # tokens inside an idiom before its last word, and all tokens of idioms
    inside = np.zeros(total + 1, np.int64)
    ends = np.flatnonzero(idiom_n)
    np.add.at(inside, ends - idiom_n[ends] + 1, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:total] > 0
    idiomatic = inside | (idiom_n > 0)

    own = np.where(idiom_n > 0, trie.valence[idiom], valence[code])
    hit = np.flatnonzero(~np.isnan(own) & ~inside)
    h_row, h_pos = row[hit], pos[hit]
    caps = mixed[h_row]
    v = own[hit]
    back = np.maximum(idiom_n[hit] - 1, 0)       # from the last word of an idiom to its first
    v += np.where(upper[code[hit]] & caps, np.where(v > 0, 1, -1) * params.caps_increment, 0.0)
    # token at distance d, its class (plain where the text begins)
    place = {d: np.maximum(hit - back - d, 0) for d in (1, 2, 3)}
    there = {d: h_pos - back >= d for d in (1, 2, 3)}
    ctx = {d: np.where(there[d], code[place[d]], classes.plain) for d in (1, 2, 3)}
    # the entry of several words that ends at distance e
    entry = {e: np.where(there[e], mod[place[e]], 0) for e in (1, 2)}
    length = {e: np.where(there[e], mod_n[place[e]], 0) for e in (1, 2)}
    swallowed = length[1] > length[2]
    entry[2], length[2] = (np.where(swallowed, 0, x[2]) for x in (entry, length))
    for d, damp in ((1, 1.0), (2, params.damp_distance_2), (3, params.damp_distance_3)):
        c = ctx[d]
        act = ~in_lex[c] & ~(there[d] & idiomatic[place[d]])
        with_boost = act & ~np.isnan(boost[c])
        s = np.where(with_boost, np.where(v < 0, -boost[c], boost[c]), 0.0)
        s += np.where(with_boost & upper[c] & caps,
                      np.where(v > 0, 1, -1) * params.caps_increment, 0.0)
        v = v + s * damp
        covered = (d <= length[1]) | ((d >= 2) & (d <= length[2] + 1) & (length[2] > 0))
        negates = act & ~covered & (neg[c] | (near[c] if d == 1 else False))
        v = np.where(negates, v * params.negation_scalar, v)
        if d > 1:
            scalar = trie.boost[entry[d - 1]]
            v = np.where(entry[d - 1] > 0, (v + np.where(v < 0, -scalar, scalar))
                         * trie.factor[entry[d - 1]], v)
    at = but_at[h_row]
    v = np.where((at >= 0) & (h_pos < at), v * params.but_before,
                 np.where((at >= 0) & (h_pos > at), v * params.but_after, v))

    # exact sums in units of 10^-12, in two parts so that none overflows
    unit = np.rint(v * _UNIT).astype(np.int64)

    def total_of(x: np.ndarray, where: np.ndarray) -> np.ndarray:
        high, low = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        np.add.at(high, h_row[where], x[where] // 10 ** 6)
        np.add.at(low, h_row[where], x[where] % 10 ** 6)
        return np.array([(int(a) * 10 ** 6 + int(b)) / _UNIT for a, b in zip(high, low)], float)

    up, down = unit > 0, unit < 0
    return [n_tok, np.array([t.count("!") if t else 0 for t in texts], np.int64),
            np.array([t.count("?") if t else 0 for t in texts], np.int64),
            total_of(unit, up | down), total_of(unit + _UNIT, up), total_of(unit - _UNIT, down),
            np.bincount(h_row[up], minlength=len(texts)).astype(np.int64),
            np.bincount(h_row[down], minlength=len(texts)).astype(np.int64)]


def _with_sums(df: DataFrame, text_col: str, keep: list[str], words: WordTable,
               params: ScorerParams) -> DataFrame:
    """``keep`` columns and the sums of each row's text; one Arrow batch in,
    one out, a few hundred texts at a time."""
    src = df.select(*keep, F.col(text_col).cast("string").alias("_s_text"))
    kinds = ["long"] * 3 + ["double"] * 3 + ["long"] * 2
    out = src.select(*keep, *[F.lit(0).cast(k).alias(c) for c, k in zip(_SUMS, kinds)])
    names, width, rows = out.columns, len(keep), 256

    def run(batches):
        classes = _Classes(words, params)
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                sums = text_sums(part.column(width).to_pylist(), classes, params)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(width)), *(pa.array(x) for x in sums)],
                    names=names)

    return src.mapInArrow(run, out.schema)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin to ``min_partitions`` when the input has fewer files.

    Off by default. For a few unsplittable files on many cores; an input with
    that many files, of any size, is left as it is. Starts no job."""
    if min_partitions and len(df._jdf.inputFiles()) < min_partitions:  # paths stay in the JVM
        return df.repartition(min_partitions)
    return df


def emphasis(n_excl: Column, n_q: Column, params: ScorerParams = DEFAULT_PARAMS) -> Column:
    """Rule 7: amplification from "!" and "?" counts."""
    ep = F.least(n_excl, F.lit(params.exclaim_max)) * F.lit(params.exclaim_increment)
    qm = (F.when(n_q <= 1, F.lit(0.0))
           .when(n_q <= 3, n_q * F.lit(params.question_increment))
           .otherwise(F.lit(params.question_max_emphasis)))
    return ep + qm


def score_text(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame,
               text_col: str = "body", keep: list[str] | None = None,
               out_col: str = "vaderScore", all_scores: bool = False,
               params: ScorerParams = DEFAULT_PARAMS, min_partitions: int | None = None,
               max_words: int = MAX_WORDS, max_bytes: int = MAX_WORD_BYTES) -> DataFrame:
    """V1-V6: every row of ``df`` with its score in ``out_col`` (and ``neg``,
    ``neu``, ``pos`` with ``all_scores``).

    ``keep`` lists the columns to carry (default: all; columns that the
    scores replace are dropped). Building the plan starts no job on ``df``
    unless the lexicon passes the bounds (see ``word_table``).
    ``min_partitions``: see ``spread``."""
    scores = (["neg", "neu", "pos"] if all_scores else []) + [out_col]
    keep = [c for c in (df.columns if keep is None else keep) if c not in scores]
    words = word_table(lexicon, modifiers, df, text_col, max_words, max_bytes)
    # only the columns needed are spread
    need = df.select(*dict.fromkeys([*keep, text_col]))
    rows = _with_sums(spread(need, min_partitions), text_col, keep, words, params)
    n_tok, emph = F.col("_s_tok"), emphasis(F.col("_s_excl"), F.col("_s_q"), params)
    s = F.col("_s_sum")
    s = F.when(s > 0, s + emph).when(s < 0, s - emph).otherwise(s)
    norm = s / F.sqrt(s * s + F.lit(params.alpha))
    compound = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), norm)), 4)
    out = []
    if all_scores:
        ps, ns = F.col("_s_pos"), F.col("_s_neg")
        neu = (n_tok - F.col("_s_npos") - F.col("_s_nneg")).cast("double")
        ps2 = F.when(ps > F.abs(ns), ps + emph).otherwise(ps)
        ns2 = F.when(ps < F.abs(ns), ns - emph).otherwise(ns)
        total = ps2 + F.abs(ns2) + neu

        def prop(x: Column) -> Column:
            return F.when(n_tok == 0, F.lit(0.0)).otherwise(F.round(F.abs(x / total), 3))

        out = [prop(ns2).alias("neg"), prop(neu).alias("neu"), prop(ps2).alias("pos")]
    return rows.select(*keep, *out, compound.alias(out_col))


def score_with(df: DataFrame, scorer, text_col: str = "body",
               out_col: str = "vaderScore") -> DataFrame:
    """Attach a score from any Column -> Column function.

    For a user's own expression or a ``pandas_udf``; the built-in scorer is
    ``score_text``.
    """
    return df.withColumn(out_col, scorer(F.col(text_col)).cast("double"))
