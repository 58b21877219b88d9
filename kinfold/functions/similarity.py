"""Similarities of two strings: native expressions, and one Arrow UDF for alignment measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import words


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; none for a shorter string."""
    at = F.sequence(F.lit(1), F.length(c) - (n - 1))
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(at, lambda i: F.substr(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / either)


def gram_jaccard(a: Column, b: Column, n: int, *, both_empty: float = 0.0, whole: bool = False) -> Column:
    """Jaccard similarity of the n-grams; 0 if one string has none, ``both_empty`` if both have none.

    With ``whole``, a string too short for a gram is one gram as a whole.
    """
    x, y = grams(a, n), grams(b, n)
    if whole:
        x, y = (F.when(F.length(c) >= n, g).otherwise(F.array(c)) for c, g in ((a, x), (b, y)))
    none = (F.size(x) == 0, F.size(y) == 0)
    return F.when(none[0] & none[1], both_empty).when(none[0] | none[1], 0.0).otherwise(jaccard(x, y))


def word_jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)), both_empty)


def overlap(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def same_prefix(a: Column, b: Column, n: int) -> Column:
    return ((F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))).cast("double")


def length_ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / most)


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    rows, free, first = _bits(b), (1 << len(b)) - 1, []
    for i, x in enumerate(a):
        low = max(0, i - reach)
        near = (rows.get(x, 0) & free) >> low
        at = near & -near
        if at and at.bit_length() - 1 + low <= i + reach:
            free ^= at << low
            first.append(x)
    m = len(first)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(first, (y for j, y in enumerate(b) if not free >> j & 1), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_one(a: str, b: str) -> float:
    score = _jaro(a, b)
    if score <= 0.7:
        return score
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return score + same * 0.1 * (1 - score)


def _bits(a: str) -> dict[str, int]:
    """Where each letter stands, as the bits of one number."""
    rows: dict[str, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    return rows


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    if a == b:
        return len(a)
    rows, full = _bits(a), (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & rows.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _lcs_of_starts(a: str, b: str) -> list[int]:
    """The same for ``a`` and b[:1], b[:2] and so on."""
    rows, full = _bits(a), (1 << len(a)) - 1
    s, out = full, []
    for y in b:
        u = s & rows.get(y, 0)
        s = ((s + u) | (s - u)) & full
        out.append(len(a) - s.bit_count())
    return out


def ratio_one(a: str, b: str) -> float:
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def sort_ratio_one(a: str, b: str) -> float:
    return ratio_one(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio_one(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    one, two = (f"{both} {' '.join(sorted(z))}".strip() for z in (x - y, y - x))
    return max(ratio_one(one, two), *((ratio_one(both, one), ratio_one(both, two)) if both else (0.0,)))


def partial_ratio_one(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows cut at its ends included.

    All windows at one end are starts of the longest of them, and are measured in one go. Others are measured
    one by one, if they can be better: a window's subsequence is at most one letter longer than its neighbour's.
    """
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    if short in long:
        return 1.0
    n = len(short)
    starts, ends = _lcs_of_starts(short, long[:n]), _lcs_of_starts(short[::-1], long[::-1][:n])
    best = max(2 * x / (n + m) for found in (starts, ends) for m, x in enumerate(found, 1))
    most = starts[-1]
    for k in range(1, len(long) - n):
        most += 1
        if 2 * most / (n + n) > best:
            most = _lcs(short, long[k : k + n])
            best = max(best, 2 * most / (n + n))
    return best


def city_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the long words that are no numbers; 1 if neither string has any."""
    x, y = (F.array_distinct(F.filter(words(c), lambda w: (F.length(w) > 3) & ~w.rlike("^[0-9]+$"))) for c in (a, b))
    return jaccard(x, y, 1.0)


def initials_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words' first letters; 0 if a string has none."""
    x, y = (F.array_distinct(F.transform(words(c), lambda w: F.left(w, F.lit(1)))) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(jaccard(x, y))


def house_distance(a: Column, b: Column) -> Column:
    """Difference of the first words that are numbers, 999 at most, as a share of that; 0.5 if one has none."""
    x, y = (F.get(F.filter(words(c), lambda w: w.rlike("^[0-9]+$")), F.lit(0)).try_cast("decimal(38,0)") for c in (a, b))
    apart = F.abs(x - y)
    return F.when(apart.isNull(), 0.5).otherwise(F.least(apart, F.lit(999)).cast("double") / 999)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


ALIGNED = {"jw": jaro_winkler_one, "ratio": ratio_one, "token_sort": sort_ratio_one, "token_set": set_ratio_one, "partial": partial_ratio_one}


def aligned(wanted: dict[str, tuple[str, ...]]):
    """A function of two columns for each key of ``wanted`` to a struct of its measures, such as name_jw for name: (jw,).

    One Arrow batch at a time; each distinct pair of strings is measured once in it, by the measures asked for.
    """

    @pandas_udf(StructType([StructField(f"{k}_{x}", DoubleType()) for k, measures in wanted.items() for x in measures]))
    def measure(*columns: pd.Series) -> pd.DataFrame:
        out = {}
        for (key, measures), a, b in zip(wanted.items(), columns[::2], columns[1::2], strict=True):
            pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
            where, once = pairs.factorize()
            for x in measures:
                found = pd.Series([ALIGNED[x](p, q) for p, q in once], dtype="float64")
                out[f"{key}_{x}"] = found.take(where).to_numpy()
        return pd.DataFrame(out)

    return measure


def jaro_winkler(a: Column, b: Column) -> Column:
    return aligned({"x": ("jw",)})(a, b)["x_jw"]
