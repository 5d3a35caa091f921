"""Column expressions of the engine; all run in the JVM, none needs a Python worker."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """NaN counts as missing everywhere."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def series(*more: str) -> Window:
    """The window of one series in date order."""
    return Window.partitionBy("symbol", *more).orderBy("date")


# --- prices ---


def log_return(now: Column, before: Column, scale: float = 100.0) -> Column:
    return scale * F.ln(F.try_divide(now, before))


def parkinson(high: Column, low: Column, scale: float = 100.0) -> Column:
    return F.pow(log_return(high, low, scale), F.lit(2.0)) / (4 * math.log(2))


def garman_klass(open_: Column, high: Column, low: Column, close: Column, scale: float = 100.0) -> Column:
    hl, co = log_return(high, low, scale), log_return(close, open_, scale)
    return 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co


# --- losses (y is a return, var and es are positive losses) ---


def tick_loss(y: Column, var: Column, alpha: float) -> Column:
    return (F.lit(alpha) - F.when(y <= -var, 1.0).otherwise(0.0)) * (y + var)


def _positive(c: Column, what: str) -> Column:
    return F.when(c > 0, c).when(c.isNull(), c).otherwise(F.raise_error(F.lit(f"{what} must be positive")).cast("double"))


def fz0_loss(y: Column, var: Column, es: Column, alpha: float) -> Column:
    """The zero-homogeneous Fissler-Ziegel loss; a non-positive ES is an error."""
    e = _positive(es, "ES forecasts")
    return F.when(y <= -var, -var - y).otherwise(0.0) / (alpha * e) + var / e + F.ln(e) - 1.0


def qlike(variance: Column, proxy: Column) -> Column:
    v = _positive(variance, "variance forecasts")
    return F.ln(v) + proxy / v


def squared_error(variance: Column, proxy: Column) -> Column:
    return F.pow(variance - proxy, F.lit(2.0))


def hit(y: Column, var: Column) -> Column:
    """An exception: the loss is strictly above VaR."""
    return -y > var


# --- statistics ---


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def erfc(x: Column, terms: int = 150) -> Column:
    """1 - erf(x) for x >= 0, by the series in x^(2n+1) / (2n+1)!!; absolute error about 1e-15."""
    z = F.least(x, F.lit(7.0))
    start = F.struct(z.alias("term"), z.alias("sum"))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        start,
        lambda s, n: F.struct((s["term"] * 2 * z * z / (2 * n + 1)).alias("term"), (s["sum"] + s["term"] * 2 * z * z / (2 * n + 1)).alias("sum")),
    )["sum"]
    return F.greatest(F.lit(0.0), 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-z * z) * total)


def two_sided_p(t: Column) -> Column:
    return erfc(F.abs(t) / math.sqrt(2))


def chi2_sf(x: Column, df: int) -> Column:
    """Upper chi-squared tail for a whole number of degrees of freedom."""
    half = F.greatest(x, F.lit(0.0)) / 2
    out = erfc(F.sqrt(half)) if df % 2 else F.exp(-half)
    for k in range(1 if df % 2 else 2, df, 2):
        out = out + F.pow(half, F.lit(k / 2)) * F.exp(-half) / math.gamma(k / 2 + 1)
    return F.least(F.lit(1.0), out)


def lr_coverage(n: Column, x: Column, alpha: float) -> Column:
    """Kupiec's likelihood ratio of x exceptions in n days."""
    rate = ratio(x, n)
    seen = xlogy(x, rate) + xlogy(n - x, 1 - rate)
    asked = x * F.lit(math.log(alpha)) + (n - x) * F.lit(math.log(1 - alpha))
    return F.greatest(2 * (seen - asked), F.lit(0.0))


def lr_independence(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Christoffersen's likelihood ratio of a Markov chain against independence."""
    p01, p11 = ratio(n01, n00 + n01), ratio(n11, n10 + n11)
    p = ratio(n01 + n11, n00 + n01 + n10 + n11)
    markov = xlogy(n00, 1 - p01) + xlogy(n01, p01) + xlogy(n10, 1 - p11) + xlogy(n11, p11)
    same = xlogy(n00 + n10, 1 - p) + xlogy(n01 + n11, p)
    return F.greatest(2 * (markov - same), F.lit(0.0))


# --- MIDAS ---


def beta_weights(w: Column, lags: int) -> Column:
    raw = F.transform(F.sequence(F.lit(1), F.lit(lags)), lambda k: F.pow(1 - k / F.lit(lags + 1.0), w - 1))
    total = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
    return F.transform(raw, lambda v: v / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def level_name(level: float) -> str:
    """0.975 -> 97_5, for column names without dots."""
    return f"{level * 100:.10g}".replace(".", "_")
