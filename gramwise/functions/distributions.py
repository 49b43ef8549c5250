"""Tail probabilities for the few test statistics a fitted model reports (driver-side scalars)."""

from __future__ import annotations

import math

_TINY = 1e-300
_LARGE = 1e6


def _continued_fraction(step, start: float, limit: int = 10_000) -> float:
    """Modified Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)); ``step(m)`` gives (a_m, b_m)."""
    value = start or _TINY
    c, d = value, 0.0
    for m in range(1, limit):
        a, b = step(m)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        factor = c * d
        value *= factor
        if abs(factor - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"no value of the continued fraction within {limit} terms")


def _stirling_rest(a: float) -> float:
    """log Gamma(a) less Stirling's leading terms, for a of 10 and more."""
    i = 1.0 / (a * a)
    return (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / a


def log_beta(a: float, b: float) -> float:
    """log B(a, b); differences of large logarithms of the gamma function are taken term by term."""
    small, large = min(a, b), max(a, b)
    if large < 10.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # log Gamma(large) - log Gamma(large + small)
    step = small - small * math.log(large) - (large + small - 0.5) * math.log1p(small / large)
    return math.lgamma(small) + step + _stirling_rest(large) - _stirling_rest(large + small)


def beta_regularized(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); give ``rest``, 1 - x, where x is so near one that it is lost."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    if a >= _LARGE * max(b, 1.0):
        # The gamma limit with its first correction: the next term is of the order of (b / a) squared.
        log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
        return gamma_upper(b, -(a + (b - 1.0) / 2.0) * log_x)
    if b >= _LARGE * max(a, 1.0):
        return 1.0 - beta_regularized(rest, b, a, x)
    if rest < (b + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_fraction(rest, b, a, x)
    return _beta_fraction(x, a, b, rest)


def _beta_fraction(x: float, a: float, b: float, rest: float) -> float:
    def step(n: int) -> tuple[float, float]:
        if n == 1:
            return 1.0, 1.0
        m, odd = divmod(n - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    log_x = math.log(x) if x < 0.5 else math.log1p(-rest)
    log_rest = math.log(rest) if rest < 0.5 else math.log1p(-x)
    return math.exp(a * log_x + b * log_rest - log_beta(a, b)) / a * _continued_fraction(step, 0.0)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * math.exp(log_front)

    def step(n: int) -> tuple[float, float]:
        if n == 1:
            return 1.0, x + 1.0 - a
        i = n - 1
        return -i * (i - a), x + 2 * i + 1.0 - a

    return math.exp(log_front) * _continued_fraction(step, 0.0)


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def f_upper(x: float, df1: float, df2: float) -> float:
    whole = df2 + df1 * x
    return beta_regularized(df2 / whole, df2 / 2.0, df1 / 2.0, df1 * x / whole) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    whole = df + t * t
    return beta_regularized(df / whole, df / 2.0, 0.5, t * t / whole)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_quantile(p: float, df: float) -> float:
    """t with upper tail (1 - p), for p above one half."""
    tail = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        low, high = high, high * 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if t_two_sided(middle, df) > tail:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)
