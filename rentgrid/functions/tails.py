"""Tail probabilities of test statistics: scalars on the driver, one per test."""

from __future__ import annotations

import math


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared: the regularised incomplete gamma Q(df/2, x/2)."""
    a, t = df / 2.0, x / 2.0
    if t <= 0:
        return 1.0
    scale = math.exp(-t + a * math.log(t) - math.lgamma(a))
    if t < a + 1:                                   # power series of the lower tail
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= t / n
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300                                   # continued fraction of the upper tail
    b = t + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h * scale
