"""Special functions from the standard library and numpy alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def norm_pdf(x: float) -> float:
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(q: float) -> float:
    if not 0 < q < 1:
        return math.nan if not 0 <= q <= 1 else math.copysign(math.inf, q - 0.5)
    return _NORMAL.inv_cdf(q)


def two_sided_p(t: float) -> float:
    """P(|Z| >= |t|) of a standard normal; nan for nan."""
    return math.erfc(abs(t) / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of a chi-squared distribution with a whole number of degrees of freedom."""
    if x is None or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, k = math.erfc(math.sqrt(half)), 1
    else:
        total, k = math.exp(-half), 2
    while k < df:
        total += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1))
        k += 2
    return min(1.0, total)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz' continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * value / a


def t_pdf(x: float, nu: float) -> float:
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * nu) - (nu + 1) / 2 * math.log1p(x * x / nu))


def t_cdf(x: float, nu: float) -> float:
    tail = 0.5 * betainc(nu / 2, 0.5, nu / (nu + x * x))
    return tail if x < 0 else 1 - tail


def t_ppf(q: float, nu: float) -> float:
    """Newton steps on the lower tail's logarithm, kept inside a shrinking bracket."""
    if not 0 < q < 1:
        return norm_ppf(q)
    if q > 0.5:
        return -t_ppf(1 - q, nu)
    if q == 0.5:
        return 0.0
    low, high = -2.0, 0.0
    while t_cdf(low, nu) > q:
        low *= 2
    x = max(low, norm_ppf(q))
    for _ in range(200):
        p = t_cdf(x, nu)
        if p > q:
            high = x
        else:
            low = x
        slope = t_pdf(x, nu)
        step = x - (math.log(p) - math.log(q)) * p / slope if p > 0 and slope > 0 else low
        after = step if low < step < high else (low + high) / 2
        if abs(after - x) <= 1e-15 * max(1.0, abs(x)):
            return after
        x = after
    return x


def gauss_legendre(f, a: float, b: float, n: int = 200) -> float:
    """Integral of f over (a, b), with the nodes crowded towards a (for an open end there)."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    u = (nodes + 1) / 2
    # x = a + (b - a) u^4 flattens a singularity at a.
    x = a + (b - a) * u**4
    return float(sum(w / 2 * 4 * v**3 * (b - a) * f(y) for w, v, y in zip(weights, u, x, strict=True)))
