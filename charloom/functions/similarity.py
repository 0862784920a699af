"""String and vector similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 for null, empty, zero or unequally long vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(fits & (norm > 0), F.try_divide(dot(a, b), norm)), F.lit(0.0))


def jaro_of(a: str, b: str) -> float:
    """Jaro similarity: matches within half of the longer length, half-counted transpositions."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    t = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def edits_of(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def similar_of(a: str, b: str, lev_max: int = 2, jw_min: float = 0.85) -> bool:
    """The similarity rule for one pair: within lev_max edits, or jw_min by Jaro-Winkler; an empty side never is."""
    if not a or not b:
        return False
    if abs(len(a) - len(b)) <= lev_max and edits_of(a, b) <= lev_max:
        return True
    j, prefix = jaro_of(a, b), 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return j + prefix * 0.1 * (1 - j) >= jw_min


def jaro_many(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """jaro_of() of many pairs: rows of code points padded with zeros, and their lengths. Pairs of the same two lengths are worked
    out together, a character of the left names at a time."""
    out = np.empty(len(x))
    kinds = nx.astype(np.int64) << 32 | ny
    by = np.argsort(kinds, kind="stable")
    for rows in np.split(by, np.nonzero(np.diff(kinds[by]))[0] + 1) if len(by) else []:
        n, m = int(nx[rows[0]]), int(ny[rows[0]])
        out[rows] = _jaro_alike(x[rows, :n], y[rows, :m]) if n and m else float(n == m)
    return out


def _jaro_alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    (rows, n), m = a.shape, b.shape[1]
    reach = max(max(n, m) // 2 - 1, 0)
    free, used = np.ones((rows, m), bool), np.zeros((rows, n), bool)
    for i in range(n):
        low, high = max(0, i - reach), min(m, i + reach + 1)
        if low >= high:
            continue
        same = (b[:, low:high] == a[:, i, None]) & free[:, low:high]
        at = np.nonzero(same.any(axis=1))[0]
        free[at, low + same[at].argmax(axis=1)] = False
        used[at, i] = True
    matched = used.sum(axis=1)
    # the matched characters of either side, in order
    left = np.take_along_axis(a, np.argsort(~used, axis=1, kind="stable"), 1)
    right = np.take_along_axis(b, np.argsort(free, axis=1, kind="stable"), 1)
    width = min(n, m)
    moved = ((left[:, :width] != right[:, :width]) & (np.arange(width) < matched[:, None])).sum(axis=1) // 2
    some = np.maximum(matched, 1)
    j = (matched / n + matched / m + (matched - moved) / some) / 3
    return np.where(matched > 0, np.where((n == m) & (a[:, :width] == b[:, :width]).all(axis=1), 1.0, j), 0.0)


@F.pandas_udf(DoubleType())
def jaro(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else jaro_of(x, y) for x, y in zip(a, b)], dtype="float64")


def winkler(j: Column, a: Column, b: Column, weight: float = 0.1) -> Column:
    """Jaro-Winkler from Jaro: up to four equal leading characters always lift it."""
    same = [F.substr(a, F.lit(1), F.lit(k)) == F.substr(b, F.lit(1), F.lit(k)) for k in range(1, 5)]
    long = [(F.length(a) >= k) & (F.length(b) >= k) for k in range(1, 5)]
    prefix = sum((F.when(s & n, 1).otherwise(0) for s, n in zip(same, long)), F.lit(0))
    return j + prefix * weight * (F.lit(1.0) - j)


def jaro_winkler(a: Column, b: Column, weight: float = 0.1) -> Column:
    return winkler(jaro(a, b), a, b, weight)


def similar_natively(a: Column, b: Column, lev_max: int = 2) -> Column:
    """The part of the similarity rule that stays in the JVM: equal, or within lev_max edits; an empty side never is."""
    near = F.levenshtein(a, b, lev_max)
    return (a != "") & (b != "") & ((a == b) | ((near >= 0) & (near <= lev_max)))


def may_be_similar(a: Column, b: Column, jw_min: float = 0.85) -> Column:
    """A bound on lengths and first characters that every pair with Jaro-Winkler >= jw_min meets: a match ratio r of the lengths
    bounds Jaro by (2 + r) / 3, and without an equal first character there is no lift."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    bound = (F.lit(2.0) + ratio) / 3
    lifted = F.when(F.substr(a, F.lit(1), F.lit(1)) == F.substr(b, F.lit(1), F.lit(1)), bound * 0.6 + 0.4).otherwise(bound)
    return (a != "") & (b != "") & (lifted >= F.lit(jw_min) - 1e-9)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_embedding(text: Column, dim: int = 256) -> Column:
    """Deterministic unit vector: chained sha-512 digests, each byte as (b - 128) / 128."""

    def chain(first: Column, n: int) -> Column:
        return first if n <= 1 else let(first, lambda d: F.concat(d, chain(F.sha2(F.unhex(d), 512), n - 1)))

    def unit(raw: Column) -> Column:
        return let(F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, v: s + v * v)), lambda norm: F.transform(raw, lambda v: F.when(norm > 0, v / norm).otherwise(v)))

    byte = lambda digits, i: (F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128.0) / 128.0
    raw = let(chain(F.sha2(F.encode(text, "UTF-8"), 512), -(-dim // 64)), lambda digits: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(digits, i)))
    return let(raw, unit)
