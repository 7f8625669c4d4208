"""Distribution functions that columns lack, over NumPy arrays: for Arrow kernels and bounded driver-side numbers."""

from __future__ import annotations

import math

import numpy as np

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function, by Gauss-Legendre quadrature of the density from 0 (NaN stays)."""
    x = np.asarray(x, np.float64)
    half = np.clip(x, -8.5, 8.5)[..., None] / 2
    area = (np.exp(-((half * (_NODES + 1)) ** 2) / 2) * _WEIGHTS).sum(-1) * half[..., 0] / math.sqrt(2 * math.pi)
    return np.clip(0.5 + area, 0.0, 1.0)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln Gamma for x > 0: recurrence up to 8, then the asymptotic series."""
    x = np.asarray(x, np.float64).copy()
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def beta_cdf(x: np.ndarray, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function on [0, 1], by its continued fraction on the side where that converges fast."""
    x = np.clip(np.asarray(x, np.float64), 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    t = np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(t), 1 - (p + q) * t / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for term in (m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(t) + q * np.log1p(-t))
    part = np.where(t > 0, front * h / p, 0.0)
    return np.where(swap, 1 - part, part)


def beta_ppf(u: np.ndarray, a: float, b: float) -> np.ndarray:
    """Quantile of Beta(a, b): bisection, all values at once."""
    u = np.asarray(u, np.float64)
    lo, hi = np.zeros_like(u), np.ones_like(u)
    for _ in range(50):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < u
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def ks_exact(d: float, m: int, n: int) -> float:
    """P(D >= d) of the two-sample Kolmogorov-Smirnov statistic of m and n distinct values.

    All orders of the two samples are lattice paths from (0, 0) to (m, n); the
    chance that one meets a point at least d off the diagonal is added up along
    antidiagonals, m + n steps over at most m + 1 points. Distances are
    compared in whole numbers, in units of 1 / lcm(m, n).
    """
    if m < 1 or n < 1:
        return math.nan
    unit = math.lcm(m, n)
    least = round(d * unit)
    if abs(d * unit - least) > 1e-3:
        least = math.ceil(d * unit)
    if least <= 0:
        return 1.0
    i = np.arange(m + 1)
    met = np.zeros(m + 1)
    for s in range(1, m + n + 1):
        lo, hi = max(0, s - n), min(m, s)
        k = i[lo:hi + 1]
        from_left = np.where(k > 0, np.append(0.0, met)[k], 0.0)  # met[k - 1], a path of one more of the first sample
        new = from_left * (k / s) + np.where(s - k > 0, met[k], 0.0) * ((s - k) / s)
        off = np.abs(k * (unit // m) - (s - k) * (unit // n)) >= least
        met[lo:hi + 1] = np.where(off, 1.0, new)
    return float(min(1.0, met[m]))
