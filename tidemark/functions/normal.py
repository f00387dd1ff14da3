"""Normal distribution functions and closed-form tail areas for one-row summaries."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()
EULER = 0.5772156649


def cdf(x: float) -> float:
    return NORMAL.cdf(x)


def quantile(p: float) -> float:
    return NORMAL.inv_cdf(p)


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with ``k`` degrees > x), by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    if z > a + 1:  # continued fraction of the upper part
        b, c, d = z + 1 - a, 1e300, 1 / (z + 1 - a)
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return math.exp(-z + a * math.log(z) - math.lgamma(a)) * h
    term = total = 1 / a
    for i in range(1, 1000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return 1 - math.exp(-z + a * math.log(z) - math.lgamma(a)) * total


def student_tail(t: float, n: int) -> float:
    """Two-sided tail of Student's t by numeric integration of its density."""
    c = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
    steps, top = 4000, abs(t)
    f = lambda x: c * (1 + x * x / n) ** (-(n + 1) / 2)
    w = top / steps
    area = w / 3 * (f(0) + f(top) + sum((4 if i % 2 else 2) * f(i * w) for i in range(1, steps))) if top else 0.0
    return max(0.0, 1 - 2 * area)
