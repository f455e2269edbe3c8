"""The exact two-sided sign test as an expression of built-in functions.

The tail of the binomial distribution with p = 1/2 is the regularised incomplete beta function: the last term, by
Stirling's series for the factorials and their deviances, times a continued fraction that Lentz's method folds over
a number of terms that grows with the cube root of n. No array of n, no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's series for the logarithm of n!: coefficients of 1/n, 1/n^3, ...
_SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_TINY = 1e-300


def _rest(n: Column) -> Column:
    """ln n! less Stirling's formula, n >= 1."""
    plain = 0.5 * F.log(2 * math.pi * n) + n * F.log(n) - n
    series = sum((F.lit(c) / F.pow(n, F.lit(2.0 * i + 1)) for i, c in enumerate(_SERIES)), F.lit(0.0))
    return F.when(n <= 16, F.log(F.factorial(F.least(n, F.lit(16.0)).cast("int"))) - plain).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def last_term(n: Column, k: Column) -> Column:
    """C(n, k) / 2^n for doubles 0 <= k <= n / 2."""
    one = F.greatest(k, F.lit(1.0))
    least = F.greatest(n, F.lit(2.0))
    whole = _rest(least) - _rest(one) - _rest(least - one) - _deviance(one, least / 2) - _deviance(least - one, least / 2)
    return F.when((k < 1) | (n < 2), F.pow(F.lit(0.5), n)).otherwise(F.exp(whole) * F.sqrt(least / (2 * math.pi * one * (least - one))))


def _not_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(a: Column, b: Column, terms: Column) -> Column:
    """Lentz's method for the incomplete beta function's fraction at 1/2."""
    d = 1 / _not_zero(1 - (a + b) / (2 * (a + 1)))

    def step(s: Column, d_term: Column) -> Column:
        d = 1 / _not_zero(1 + d_term * s["d"])
        c = _not_zero(1 + d_term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def even(s: Column, i: Column) -> Column:
        m = i.cast("double")
        return step(s, m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m)))

    def odd(s: Column, i: Column) -> Column:
        m = i.cast("double")
        return step(s, -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1)))

    # terms alternate: 2m is the m-th even one, 2m + 1 the odd one after it
    both = lambda s, i: F.when(i % 2 == 0, even(s, i / 2)).otherwise(odd(s, (i - 1) / 2))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(2), 2 * terms + 1), start, both)["h"]


def two_sided_sign_test(wins: Column, losses: Column) -> Column:
    """min(1, 2 P(X <= min(wins, losses))) for X of wins + losses fair coins; 1 without any."""
    n, k = (wins + losses).cast("double"), F.least(wins, losses).cast("double")
    terms = (20 + 5 * F.cbrt(n)).cast("int")
    tail = last_term(n, k) * _fraction(n - k, k + 1, terms)
    return F.when(2 * k >= n - 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))
