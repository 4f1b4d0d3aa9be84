"""String similarities for names: on the driver for column names, as Arrow-batched functions for value pairs."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, hits = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hits.append((i, j))
                break
    if not hits:
        return 0.0
    m = len(hits)
    from_b = [b[j] for j in sorted(j for _, j in hits)]
    swaps = sum(a[i] != c for (i, _), c in zip(hits, from_b)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@lru_cache(maxsize=100_000)
def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + 0.1 * prefix * (1 - j) if j > 0.7 else j


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    full_x, full_y = (both + " " + only_x).strip(), (both + " " + only_y).strip()
    scores = [ratio(full_x, full_y)]
    if both:
        scores += [ratio(both, full_x), ratio(both, full_y)]
    return max(scores)


def name_level(a: str | None, b: str | None) -> str:
    """Agreement of two normalised person names: exact, high, medium, different or null; initials match names."""
    if not a or not b:
        return "null"
    if a == b:
        return "exact"
    x, y = a.split(), b.split()
    if sorted(x) == sorted(y):
        return "high"
    last = jaro_winkler(x[-1], y[-1])
    fx, fy = x[0], y[0]
    initial = (len(fx) == 1 or len(fy) == 1) and fx[0] == fy[0]
    if last >= 0.94 and len(x) > 1 and len(y) > 1:
        if initial:
            return "high"
        first = jaro_winkler(fx, fy)
        if first >= 0.92:
            return "high"
        if first >= 0.80 or fx[0] == fy[0]:
            return "medium"
        return "different"
    whole = jaro_winkler(a, b)
    return "high" if whole >= 0.95 else "medium" if whole >= 0.88 else "different"


def string_level(a: str | None, b: str | None) -> str:
    if not a or not b:
        return "null"
    if a == b:
        return "exact"
    s = max(jaro_winkler(a, b), token_set_ratio(a, b) if " " in a or " " in b else 0.0)
    return "high" if s >= 0.94 else "medium" if s >= 0.85 else "different"


@F.pandas_udf(T.StringType())
def name_levels(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([name_level(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def string_levels(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([string_level(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def jaro_winklers(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)])
