"""Sample counts, distribution summaries and dependence of return series.

Input is (symbol, date, x); every operator gives rows by symbol.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import chi2_sf, clean, erfc, series, two_sided_p


def _values(df: DataFrame, x: str) -> DataFrame:
    return df.select("symbol", "date", clean(F.col(x)).alias("x")).filter("x is not null")


def sample_counts(df: DataFrame, development: tuple[str, str], locked: tuple[str, str]) -> DataFrame:
    """Days before development, in it, and in the locked test, in one pass."""
    d = F.col("date")
    lit = lambda s: F.lit(s).cast("date")
    return df.groupBy("symbol").agg(
        F.count_if(d < lit(development[0])).alias("before_development"),
        F.count_if((d >= lit(development[0])) & (d <= lit(development[1]))).alias("development"),
        F.count_if((d >= lit(locked[0])) & (d <= lit(locked[1]))).alias("locked_test"),
    )


def check_sample_fits(df: DataFrame, development, locked, window: int) -> list[dict]:
    rows = [r.asDict() for r in sample_counts(df, development, locked).collect()]  # one row a symbol
    for r in rows:
        if r["before_development"] < window:
            raise ValueError(f"Only {r['before_development']} trading days precede the development period, but the estimation window needs {window}.")
        empty = [k for k in ("development", "locked_test") if not r[k]]
        if empty:
            raise ValueError(f"No data in sample period(s): {empty}")
    return rows


def distribution_summary(df: DataFrame, x: str = "ret") -> DataFrame:
    """n, mean, sd (n - 1), t of the mean, skewness, excess kurtosis (population) and Jarque-Bera."""
    m = _values(df, x).groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return m.withColumn("t_mean", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n"))).withColumn("jarque_bera", jb).withColumn("jb_p", chi2_sf(F.col("jarque_bera"), 2))


def tail_counts(df: DataFrame, x: str = "ret", thresholds: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """Days beyond k standard deviations, and how many a normal distribution would have."""
    v = _values(df, x)
    moments = v.groupBy("symbol").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    z = F.abs(F.try_divide(F.col("x") - F.col("mean"), F.col("sd")))
    counts = v.join(moments, "symbol").groupBy("symbol").agg(F.count("x").alias("n"), *(F.count_if(z > k).alias(f"c{k}") for k in thresholds))
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("observed")) for k in thresholds))
    return counts.select("symbol", "n", F.explode(rows).alias("r")).select("symbol", "r.k", "r.observed", (F.col("n") * erfc(F.col("r.k") / np.sqrt(2))).alias("expected"))


def _lagged(df: DataFrame, x: str, lags) -> DataFrame:
    """All lags in one window stage."""
    w = series()
    return _values(df, x).select("symbol", "date", "x", *(F.lag("x", k).over(w).alias(f"x{k}") for k in lags))


def autocorrelations(df: DataFrame, x: str = "ret", lags: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Correlation of the overlapping pairs."""
    wide = _lagged(df, x, lags).groupBy("symbol").agg(*(F.corr("x", f"x{k}").alias(f"a{k}") for k in lags))
    return wide.select("symbol", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("autocorr")) for k in lags))).alias("r")).select("symbol", "r.*")


def ljung_box(df: DataFrame, x: str = "ret", lags: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    top = max(lags)
    v = _values(df, x)
    v = v.join(v.groupBy("symbol").agg(F.avg("x").alias("mean")), "symbol").select("symbol", "date", (F.col("x") - F.col("mean")).alias("x"))
    w = series()
    products = v.select("symbol", (F.col("x") * F.col("x")).alias("p0"), *((F.col("x") * F.lag("x", k).over(w)).alias(f"p{k}") for k in range(1, top + 1)))
    sums = products.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"p{k}").alias(f"s{k}") for k in range(top + 1)))
    n = F.col("n")

    def q(m):
        return n * (n + 2) * reduce(lambda a, b: a + b, [F.pow(F.col(f"s{k}") / F.col("s0"), F.lit(2.0)) / (n - k) for k in range(1, m + 1)])

    rows = F.array(*(F.struct(F.lit(m).alias("lag"), q(m).alias("q"), chi2_sf(q(m), m).alias("p_value")) for m in lags))
    return sums.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def robust_autocorrelation(df: DataFrame, x: str = "ret", lags: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """Slope of x on its lag, with a heteroskedasticity-robust (HC0) standard error."""
    long = _lagged(df, x, lags).select("symbol", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"x{k}").alias("z")) for k in lags))).alias("r")).select("symbol", "x", "r.lag", "r.z").filter("z is not null")
    line = long.groupBy("symbol", "lag").agg(F.regr_slope("x", "z").alias("slope"), F.regr_intercept("x", "z").alias("cut"), F.avg("z").alias("zm"), F.regr_sxx("x", "z").alias("sxx"))
    e = F.col("x") - F.col("cut") - F.col("slope") * F.col("z")
    c = F.col("z") - F.col("zm")
    meat = long.join(line, ["symbol", "lag"]).groupBy("symbol", "lag", "slope", "sxx").agg(F.sum(c * c * e * e).alias("meat"))
    se = F.sqrt("meat") / F.col("sxx")
    return meat.select("symbol", "lag", F.col("slope").alias("autocorr"), se.alias("robust_se"), (F.col("slope") / se).alias("t_stat"), two_sided_p(F.col("slope") / se).alias("p_value"))


def arch_lm(df: DataFrame, x: str = "ret", lags: int = 5) -> DataFrame:
    """n R^2 of the squared demeaned series on its own lags; the normal equations are one aggregation.

    Their solution is a matrix of lags + 1 rows for each symbol, solved natively
    by Gaussian elimination over column expressions.
    """
    v = _values(df, x)
    v = v.join(v.groupBy("symbol").agg(F.avg("x").alias("mean")), "symbol").select("symbol", "date", F.pow(F.col("x") - F.col("mean"), F.lit(2.0)).alias("x"))
    w = series()
    names = [f"z{k}" for k in range(1, lags + 1)]
    z = v.select("symbol", F.col("x").alias("y"), *(F.lag("x", k).over(w).alias(n) for k, n in enumerate(names, 1))).filter(F.col(names[-1]).isNotNull())
    means = z.groupBy("symbol").agg(*(F.avg(c).alias(f"m_{c}") for c in ["y", *names]))
    centred = z.join(means, "symbol").select("symbol", *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in ["y", *names]))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    s = centred.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *(F.sum(F.col("y") * F.col(a)).alias(f"y_{a}") for a in names), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs)
    )
    # Elimination step by step, each step's rows as columns of a projection.
    k = lags
    cells = {(i, j): f"{names[min(i, j)]}_{names[max(i, j)]}" for i in range(k) for j in range(k)}
    s = s.select("symbol", "n", "yy", *(F.col(cells[i, j]).alias(f"a{i}_{j}") for i in range(k) for j in range(k)), *(F.col(f"y_{names[i]}").alias(f"b{i}") for i in range(k)), F.lit(0.0).alias("fit"))
    for p in range(k):
        s = s.withColumn("fit", F.col("fit") + F.try_divide(F.col(f"b{p}") * F.col(f"b{p}"), F.col(f"a{p}_{p}")))
        change = {}
        for i in range(p + 1, k):
            f = F.try_divide(F.col(f"a{i}_{p}"), F.col(f"a{p}_{p}"))
            for j in range(p + 1, k):
                change[f"a{i}_{j}"] = F.col(f"a{i}_{j}") - f * F.col(f"a{p}_{j}")
            change[f"b{i}"] = F.col(f"b{i}") - f * F.col(f"b{p}")
        s = s.withColumns(change) if change else s
    lm = F.col("n") * F.try_divide(F.col("fit"), F.col("yy"))
    return s.select("symbol", F.col("n"), lm.alias("lm"), chi2_sf(lm, lags).alias("p_value"))


def leverage(df: DataFrame, ret: str = "ret", proxy: str = "sq_ret", size: float = 1.0) -> DataFrame:
    """Mean next-day variance after falls and rises, for all days and for moves above size."""
    w = series()
    v = df.select("symbol", "date", clean(F.col(ret)).alias("r"), clean(F.col(proxy)).alias("p")).withColumn("next", F.lead("p").over(w)).filter("r is not null and next is not null")
    kinds = F.array(F.struct(F.lit("all days").alias("moves"), F.lit(0.0).alias("size")), F.struct(F.lit(f"above {size:g}").alias("moves"), F.lit(float(size)).alias("size")))
    e = v.select("symbol", "r", "next", F.explode(kinds).alias("k")).select("symbol", "r", "next", "k.*")
    down, up = F.col("r") < -F.col("size"), F.col("r") > F.col("size")
    out = e.groupBy("symbol", "moves").agg(F.count_if(down).alias("n_down"), F.count_if(up).alias("n_up"), F.avg(F.when(down, F.col("next"))).alias("after_down"), F.avg(F.when(up, F.col("next"))).alias("after_up"))
    return out.withColumn("ratio", F.try_divide(F.col("after_down"), F.col("after_up")))


def next_day_correlation(df: DataFrame, ret: str = "ret", proxy: str = "sq_ret") -> DataFrame:
    return df.select("symbol", F.col(ret).alias("r"), F.lead(proxy).over(series()).alias("next")).groupBy("symbol").agg(F.corr("r", "next").alias("corr"))
