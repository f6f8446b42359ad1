"""Tail probabilities in plain Python and NumPy, for use on small aggregated tables inside Arrow functions."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz recurrence."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def t_sf(t: float, df: float) -> float:
    """One-sided upper tail of Student's t, t >= 0."""
    return 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)
