"""Upper tails of the normal, t and F distributions by the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np

_lgamma, _erfc = np.vectorize(math.lgamma, otypes=[float]), np.vectorize(math.erfc, otypes=[float])


def incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    x = np.clip(np.atleast_1d(np.asarray(x, float)), 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for e in (even, odd):
            d = 1 + e * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + e / np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q))) / p
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def t_two_sided(t: np.ndarray, df: float) -> np.ndarray:
    t = np.asarray(t, float)
    return np.where(np.isfinite(t), incomplete_beta(df / 2, 0.5, df / (df + np.where(np.isfinite(t), t, 0) ** 2)), np.where(np.isnan(t), np.nan, 0.0))


def t_quantile(p: float, df: float) -> float:
    """The value below which a t variable lies with probability ``p``, by bisection of its tail."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    tail = lambda t: float(t_two_sided(np.array([t]), df)[0]) / 2
    while tail(high) > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > 1 - p else (low, middle)
    return (low + high) / 2


def f_upper(f: float, df1: float, df2: float) -> float:
    if not all(map(math.isfinite, (f, df1, df2))) or min(df1, df2) <= 0:
        return math.nan
    return float(incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * max(f, 0)))[0])
