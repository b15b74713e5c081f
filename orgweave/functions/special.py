"""Tails and quantiles of the normal, t, F and chi-square distributions, from incomplete beta and gamma functions."""

from __future__ import annotations

import math
from collections.abc import Callable

TINY, EPS, ROUNDS = 1e-300, 1e-16, 10_000


def _lentz(b0: float, terms: Callable[[int], tuple[float, float]]) -> float:
    """A continued fraction b0 + a1/(b1 + a2/(b2 + ...)) by Lentz's method; ``terms(n)`` is (a_n, b_n)."""
    f = b0 or TINY
    c, d = f, 0.0
    for n in range(1, ROUNDS):
        a, b = terms(n)
        d = 1.0 / ((b + a * d) or TINY)
        c = (b + a / c) or TINY
        f *= c * d
        if abs(c * d - 1.0) < EPS:
            break
    return f


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)

    def term(n: int) -> tuple[float, float]:
        if n == 1:
            return 1.0, 1.0
        m, odd = divmod(n - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    return front * _lentz(0.0, term)


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        total = term = 1.0 / a
        n = a
        while term > total * EPS:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    return front * _lentz(0.0, lambda n: (1.0, x + 1 - a) if n == 1 else (-(n - 1) * (n - 1 - a), x + 2 * n - 1 - a))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2)) if not math.isnan(z) else math.nan


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else 0.0 if math.isinf(f) else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    return math.nan if math.isnan(x) or df <= 0 else gamma_sf(df / 2, x / 2)


def _two_sided_quantile(tail: Callable[[float], float], alpha: float) -> float:
    """x with ``tail(x) == alpha``, by bisection of a falling function."""
    low, high = 0.0, 1.0
    while tail(high) > alpha and high < 1e300:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > alpha else (low, mid)
    return (low + high) / 2


def t_critical(alpha: float, df: float) -> float:
    return math.nan if df <= 0 else _two_sided_quantile(lambda x: t_two_sided(x, df), alpha)


def normal_critical(alpha: float) -> float:
    return _two_sided_quantile(normal_two_sided, alpha)
