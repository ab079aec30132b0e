"""String similarity: native insert/delete ratio and an Arrow composite score.

`indel` is 100 * 2*LCS/(len a + len b).  `composite` follows the usual weighted
blend of whole, token and partial ratios:

* length ratio below 1.5: max(ratio, 0.95 * token ratio)
* below 8: max(ratio, 0.9 * partial, 0.95 * 0.9 * partial token ratio)
* otherwise the partial weight is 0.6
"""

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence length by folding table rows; JVM only."""
    zero = F.lit(0)

    def next_row(row, ch):
        return F.aggregate(
            F.sequence(F.lit(1), F.length(b)), F.array(zero),
            lambda acc, j: F.array_append(acc, F.when(
                F.substr(b, j, F.lit(1)) == ch, F.get(row, j - 1) + 1
            ).otherwise(F.greatest(F.get(row, j), F.get(acc, j - 1)))))

    folded = F.aggregate(F.split(a, ""), F.array_repeat(zero, F.length(b) + 1), next_row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(a == b, F.length(a)).otherwise(
        F.element_at(folded, -1))


def indel(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs_length(a, b) / total)


# ---- small per-pair helpers used inside Arrow batches --------------------------------

def lcs(a: str, b: str) -> int:
    if a == b:
        return len(a)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = state = (1 << len(a)) - 1
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = (state + hit) | (state - hit)
    return (~state & full).bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


@lru_cache(maxsize=1 << 16)
def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(s), len(t)
    if not m:
        return 100.0 if not n else 0.0
    if s in t:
        return 100.0
    best = _best_window(s, t)
    return max(best, _best_window(t, s)) if m == n else best


def _best_window(s: str, t: str) -> float:
    """Windows that end or start on a character the short text lacks cannot win."""
    m, n = len(s), len(t)
    masks: dict[str, int] = {}
    for i, ch in enumerate(s):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << m) - 1
    best = 0.0
    for i in range(1 - m, n):
        lo, hi = max(0, i), min(n, i + m)
        if (t[hi - 1] not in masks) if lo == 0 or hi - lo == m else (t[lo] not in masks):
            continue
        state = full
        for ch in t[lo:hi]:
            hit = state & masks.get(ch, 0)
            state = (state + hit) | (state - hit)
        best = max(best, 200.0 * (~state & full).bit_count() / (m + hi - lo))
    return best


def _token_parts(a: str, b: str):
    ta, tb = set(a.split()), set(b.split())
    both = " ".join(sorted(ta & tb))
    return both, " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))


def token_ratio(a: str, b: str) -> float:
    sort_score = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    both, da, db = _token_parts(a, b)
    if both and (not da or not db):
        return 100.0
    left, right = (both + " " + da).strip(), (both + " " + db).strip()
    scores = [sort_score, ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def partial_token_ratio(a: str, b: str) -> float:
    both, da, db = _token_parts(a, b)
    if both:
        return 100.0
    whole = partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(whole, partial(da, db))


@lru_cache(maxsize=1 << 16)
def composite(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    lengths = sorted((len(a), len(b)))
    spread = lengths[1] / lengths[0]
    best = ratio(a, b)
    if spread < 1.5:
        return max(best, 0.95 * token_ratio(a, b))
    scale = 0.9 if spread < 8 else 0.6
    return max(best, scale * partial(a, b), 0.95 * scale * partial_token_ratio(a, b))


def category(a: str, b: str) -> float:
    """Similarity of two paths: whole, last segment, partial last segment."""
    la, lb = a.rsplit(">", 1)[-1], b.rsplit(">", 1)[-1]
    return max(composite(a, b), composite(la, lb), partial(la, lb))


@F.pandas_udf(T.DoubleType())
def composite_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else composite(x, y) for x, y in zip(a, b)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def category_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else category(x, y) for x, y in zip(a, b)],
                     dtype="float64")
