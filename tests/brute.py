"""Brute-force, per-text Python versions of the rules, for differential tests.

Written directly from the rule list in ``operators/score.py``; used only on
small hand-made inputs.
"""

from __future__ import annotations

import math
import re
import string
from decimal import ROUND_HALF_UP, Decimal

from sentimart.functions.lexicon import DEFAULT_PARAMS as P


def _strip(tok: str) -> str:
    s = tok.strip(string.punctuation)
    return tok if len(s) <= 2 else s


def _isupper(tok: str) -> bool:
    return any(c.isupper() for c in tok) and not any(c.islower() for c in tok)


def _round(x: float, n: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-n), rounding=ROUND_HALF_UP))


def score(text: str, lexicon: dict[str, float], modifiers: list[tuple[str, str, float]],
          idioms: dict[str, float] | None = None):
    boost = {t: s for t, k, s in modifiers if k == "booster" and " " not in t}
    neg = {t for t, k, s in modifiers if k == "negation"}
    near = {t for t, k, s in modifiers if k == "negation_near"}
    pairs = {t: ((s, 1.0) if k == "booster" else (0.0, s)) for t, k, s in modifiers
             if " " in t and k != "emoji"}
    idioms = idioms or {}
    read = text or ""
    signs = {t.split(" ", 1)[0]: t.split(" ", 1)[1] for t, k, _ in modifiers if k == "emoji"}
    at = 0
    while at < len(read):   # the longest sign first, from the left
        sign = max((x for x in signs if read.startswith(x, at)), key=len, default=None)
        if sign:
            read = read[:at] + f" {signs[sign]} " + read[at + len(sign):]
            at += len(signs[sign]) + 2
        else:
            at += 1
    raw = [t for t in re.split(r"[ \t\n\x0b\f\r]+", read) if t]
    toks = [_strip(t) for t in raw]
    low = [t.lower() for t in toks]
    n_up = sum(_isupper(t) for t in raw)
    cap = 0 < n_up < len(toks)
    but = low.index("but") if "but" in low else -1

    def longest(end, table):
        """Words of the longest entry that ends at a token, 0 if none does."""
        return max((n for n in range(2, end + 2) if " ".join(low[end - n + 1:end + 1]) in table),
                   default=0)

    ends = {i: n for i in range(len(low)) if (n := longest(i, idioms))}
    idiomatic = {j for i, n in ends.items() for j in range(i - n + 1, i + 1)}
    inside = {j for i, n in ends.items() for j in range(i - n + 1, i)}

    vals = []
    for i, (t, lw) in enumerate(zip(raw, low)):
        if i in inside or i not in ends and (lw not in lexicon or lw in boost):
            vals.append(0.0)
            continue
        first = i - ends[i] + 1 if i in ends else i
        v = idioms[" ".join(low[first:i + 1])] if i in ends else lexicon[lw]
        if _isupper(t) and cap:
            v = v + P.caps_increment if v > 0 else v - P.caps_increment
        near_n = longest(first - 1, pairs) if first >= 1 else 0
        far_n = longest(first - 2, pairs) if first >= 2 else 0
        if near_n > far_n:
            far_n = 0
        covered = {*range(1, near_n + 1), *(range(2, far_n + 2) if far_n else ())}
        for d, damp in ((1, 1.0), (2, P.damp_distance_2), (3, P.damp_distance_3)):
            if first - d < 0:
                continue
            c = low[first - d]
            if c not in lexicon and first - d not in idiomatic:
                s = 0.0
                if c in boost:
                    s = -boost[c] if v < 0 else boost[c]
                    if cap and _isupper(raw[first - d]):
                        s += P.caps_increment if v > 0 else -P.caps_increment
                v = v + s * damp
                negates = c in neg or P.negation_suffix in c or (d == 1 and c in near)
                if negates and d not in covered:
                    v = v * P.negation_scalar
            n = {2: near_n, 3: far_n}.get(d, 0)
            if n:
                p = pairs[" ".join(low[first - d + 2 - n:first - d + 2])]
                v = (v + (-p[0] if v < 0 else p[0])) * p[1]
        if but >= 0:
            if i < but:
                v = v * P.but_before
            elif i > but:
                v = v * P.but_after
        vals.append(v)
    ex = min((text or "").count("!"), P.exclaim_max) * P.exclaim_increment
    q = (text or "").count("?")
    qm = 0.0 if q <= 1 else (q * P.question_increment if q <= 3 else P.question_max_emphasis)
    emph = ex + qm
    s = sum(vals)
    if s > 0:
        s += emph
    elif s < 0:
        s -= emph
    comp = _round(max(-1.0, min(1.0, s / math.sqrt(s * s + P.alpha))), 4)
    if not toks:
        return 0.0, 0.0, 0.0, comp
    ps = sum(v + 1 for v in vals if v > 0)
    ns = sum(v - 1 for v in vals if v < 0)
    neu = sum(1 for v in vals if v == 0)
    if ps > abs(ns):
        ps += emph
    elif ps < abs(ns):
        ns -= emph
    tot = ps + abs(ns) + neu
    return (_round(abs(ns / tot), 3), _round(abs(neu / tot), 3), _round(abs(ps / tot), 3), comp)
