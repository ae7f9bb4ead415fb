"""Tail probabilities of the normal, t and chi-square distributions (no SciPy here)."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt


def normal_sf(z: float) -> float:
    return 0.5 * erfc(z / sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def chi2_sf(x: float, df: float) -> float:
    """Upper regularised incomplete gamma function at (df/2, x/2)."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b or 1e-300), (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def mann_whitney_exact_sf(u: float, n: int, m: int) -> float:
    """P(U >= u) without ties, by counting arrangements."""
    counts = [1] + [0] * (n * m)
    for i in range(1, n + 1):  # the Gaussian binomial coefficient, factor by factor
        for k in range(n * m, m + i - 1, -1):
            counts[k] -= counts[k - m - i]
        for k in range(i, n * m + 1):
            counts[k] += counts[k - i]
    return sum(counts[int(u + 0.999999999) :]) / sum(counts)
