"""Student's t distribution by the continued fraction of the incomplete beta function (no scipy)."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by the modified Lentz method."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(1000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + num * d) or tiny)
        c = (1 + num / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|); NaN where t is none or df isn't positive."""
    if t is None or math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, by bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        tail = two_sided_p(mid, df) / 2
        low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
    return (low + high) / 2
