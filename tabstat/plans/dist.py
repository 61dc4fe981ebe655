"""Tail probabilities of the test statistics, from their continued fractions and series."""

from __future__ import annotations

import math

_TINY, _EPS = 1e-300, 1e-15


def normal_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def normal_p_value(t: float) -> float:
    """Two-sided."""
    return math.erfc(abs(t) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    out = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            out *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_p_value(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if math.isnan(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_p_value(x: float, df: float) -> float:
    """P(chi-squared > x)."""
    if math.isnan(x) or df <= 0:
        return math.nan
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * _EPS:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    out = d
    for i in range(1, 10_000):
        term = -i * (i - a)
        b += 2.0
        d = term * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + term / c
        c = c if abs(c) > _TINY else _TINY
        out *= d * c
        if abs(d * c - 1.0) < _EPS:
            break
    return front * out
