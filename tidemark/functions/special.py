"""Distribution tails that Spark has no function for."""

from __future__ import annotations

import math


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, total = 1.0, 1.0 - (a + b) * x / (a + 1), 0.0
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + step / c
            c = c if abs(c) > 1e-300 else 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    if not math.isfinite(f):
        return 0.0 if f > 0 else float("nan")
    return beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))
