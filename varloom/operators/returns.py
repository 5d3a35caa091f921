"""Returns and range-based variance proxies from price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.columns import garman_klass, log_return, parkinson, series

OHLC = ("open", "high", "low", "close")
PROXIES = ("sq_ret", "parkinson", "garman_klass", "gk_overnight")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def factor_spread(bars: DataFrame) -> DataFrame:
    """(symbol, date, spread): how far the four adjustment factors of a day are apart, relative to the close's."""
    require(bars, *OHLC, *(f"adj_{c}" for c in OHLC))
    factors = [F.try_divide(F.col(f"adj_{c}"), F.col(c)) for c in OHLC]
    return bars.select("symbol", "date", F.try_divide(F.greatest(*factors) - F.least(*factors), factors[-1]).alias("spread"))


def check_common_factor(bars: DataFrame, tolerance: float = 1e-6) -> None:
    """Raises if adjusted open, high, low and close do not share one factor a day."""
    bad = factor_spread(bars).filter(F.col("spread") > tolerance).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first")).first()
    if bad["n"]:
        raise ValueError(f"Adjusted prices use different adjustment factors on {bad['n']} day(s), first on {bad['first']}.")


def returns_and_proxies(bars: DataFrame, scale: float = 100.0, adjusted: bool = False) -> DataFrame:
    """(symbol, date, ret, overnight_ret, sq_ret, parkinson, garman_klass, gk_overnight).

    One window serves both lags; the first row of a series is dropped by position.
    """
    o, h, l, c = (F.col(f"adj_{x}" if adjusted else x) for x in OHLC)
    w = series()
    return (
        bars.withColumn("prev", F.lag(c).over(w))
        .withColumn("n", F.row_number().over(w))
        .filter("n > 1")
        .select(
            "symbol",
            "date",
            log_return(c, F.col("prev"), scale).alias("ret"),
            log_return(o, F.col("prev"), scale).alias("overnight_ret"),
            parkinson(h, l, scale).alias("parkinson"),
            garman_klass(o, h, l, c, scale).alias("garman_klass"),
        )
        .select("symbol", "date", "ret", "overnight_ret", (F.col("ret") * F.col("ret")).alias("sq_ret"), "parkinson", "garman_klass", (F.col("overnight_ret") * F.col("overnight_ret") + F.col("garman_klass")).alias("gk_overnight"))
    )


def proxy_summary(proxies: DataFrame, days: int = 252) -> DataFrame:
    """By series: the yearly volatility each proxy implies and its share of the mean squared return."""
    out = [F.count(F.lit(1)).alias("n")]
    for p in PROXIES:
        out += [F.sqrt(days * F.avg(p)).alias(f"vol_{p}"), F.try_divide(F.avg(p), F.avg("sq_ret")).alias(f"share_{p}")]
    return proxies.groupBy("symbol").agg(*out)


def dividend_days(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count_if(F.col("div_cash") > 0).alias("dividend_days"))
