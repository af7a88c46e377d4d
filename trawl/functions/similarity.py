"""String similarities that Spark lacks, as one Arrow function over distinct pairs of names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How the three measures add up to a name's score.
WEIGHTS = {"jaro_winkler": 0.45, "token_sort": 0.30, "token_set": 0.25}
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in (*WEIGHTS, "total")])


def jaro_winkler(a: str, b: str) -> float:
    """0 to 1; the boost for up to four equal first characters applies above 0.7."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, f in zip(b, free, strict=True) if not f]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; each bit of a number stands for a character of ``a``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: what insertions and deletions leave in common."""
    return 100.0 * 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


@lru_cache(maxsize=200_000)
def _sorted_words(text: str) -> tuple[str, frozenset]:
    found = text.split()
    return " ".join(sorted(found)), frozenset(found)


def token_sort(a: str, b: str) -> float:
    return ratio(_sorted_words(a)[0], _sorted_words(b)[0])


def token_set(a: str, b: str) -> float:
    """100 if one's words contain the other's; else the best ratio with the common words set apart."""
    x, y = _sorted_words(a)[1], _sorted_words(b)[1]
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    rest_a, rest_b, shared = " ".join(sorted(x - y)), " ".join(sorted(y - x)), len(" ".join(sorted(both)))
    gap = shared > 0
    long_a, long_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    edits = len(rest_a) + len(rest_b) - 2 * common_subsequence(rest_a, rest_b)
    best = 100.0 * (1 - edits / (long_a + long_b))
    if gap:
        best = max(best, 100.0 * (1 - (gap + len(rest_a)) / (shared + long_a)), 100.0 * (1 - (gap + len(rest_b)) / (shared + long_b)))
    return best


@F.pandas_udf(SCORES)
def name_scores(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The three measures of two normalised names, 0 to 100 each, and their weighted sum."""
    for left, right in pairs:
        rows = [(100 * jaro_winkler(a or "", b or ""), token_sort(a or "", b or ""), token_set(a or "", b or "")) for a, b in zip(left, right, strict=True)]
        out = pd.DataFrame(rows, columns=list(WEIGHTS), dtype=float)
        yield out.assign(total=sum(w * out[k] for k, w in WEIGHTS.items()))


@F.pandas_udf(T.DoubleType())
def jaro_winkler_of(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([jaro_winkler(a or "", b or "") for a, b in zip(left, right, strict=True)], dtype=float)
