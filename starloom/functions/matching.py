"""Similarity of short strings: edit distance radii, insertion-deletion ratio and its weighted combination.

The combined ratio follows its published definition: plain ratio, and by the
quotient of lengths either token-sort and token-set ratios weighted 0.95 or
partial ratios weighted 0.9 (0.6 from a quotient of 8) times 0.95 for tokens.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUTO_SCORE, MARGIN = 90.0, 5.0


def radius(n: Column) -> Column:
    """Edit distance that a key of n characters allows: 1 up to 6, 2 up to 14, else 3."""
    return F.when(n <= 6, 1).when(n <= 14, 2).otherwise(3)


@lru_cache(maxsize=8192)
def _places(a: str) -> dict[str, int]:
    """The places of each character of a, as bits; one string meets many others, so it is kept."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    return where


@lru_cache(maxsize=8192)
def _sorted_words(a: str) -> str:
    return " ".join(sorted(a.split()))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    if not a or not b:
        return 0
    if a == b:
        return len(a)
    where = _places(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = where.get(c, 0)
        if m:
            m &= row
            row = (row + m | row - m) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, windows may hang over both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best, chars = 0.0, set(a)
    for end in range(1, len(b) + len(a)):
        lo, hi = max(0, end - len(a)), min(len(b), end)
        w = b[lo:hi]
        if hi - lo == len(a) and w[-1] not in chars or not w:
            continue
        best = max(best, ratio(a, w))
    if len(a) == len(b):
        best = max(best, ratio(a, b))
    return best


def token_sort_ratio(a: str, b: str, score=ratio) -> float:
    return score(_sorted_words(a), _sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    ab, ba = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    out = ratio(ab, ba)
    return max(out, ratio(both, ab), ratio(both, ba)) if both else out


def partial_token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y:
        return 100.0
    return partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x)))


def weighted_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    quotient = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if quotient < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if quotient <= 8 else 0.6
    tokens = max(token_sort_ratio(a, b, partial_ratio), partial_token_set_ratio(a, b))
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * tokens)


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(weighted_ratio(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else round(ratio(x, y), 6) for x, y in zip(a, b, strict=True)], dtype="float64")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, in whole-stage code."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
