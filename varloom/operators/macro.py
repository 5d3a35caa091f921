"""Monthly macroeconomic series with release dates, and what was known when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.columns import beta_weights, clean, dot

MIN_DAYS = 10


def monthly_mean(daily: DataFrame, min_days: int = MIN_DAYS) -> DataFrame:
    """(variable, reference_month, value, release_date) from (variable, date, value); a month needs min_days values."""
    month = F.trunc("date", "MM")
    return (
        daily.withColumn("value", clean(F.col("value")))
        .groupBy("variable", month.alias("reference_month"))
        .agg(F.avg("value").alias("value"), F.count("value").alias("days"))
        .filter(F.col("days") >= min_days)
        .select("variable", "reference_month", "value", F.last_day("reference_month").alias("release_date"))
    )


def real_time_growth(vintages: DataFrame) -> DataFrame:
    """100 ln(first release / month before as it stood on that day), from validity intervals; null end is open."""
    v = vintages.withColumn("value", clean(F.col("value"))).filter("value is not null").withColumn("month", F.trunc("date", "MM"))
    first = v.groupBy("variable", "month").agg(F.min_by("value", "realtime_start").alias("now"), F.min("realtime_start").alias("released"))
    before = v.select("variable", F.add_months("month", 1).alias("month"), F.col("value").alias("was"), "realtime_start", "realtime_end")
    valid = (F.col("realtime_start") <= F.col("released")) & (F.col("realtime_end").isNull() | (F.col("realtime_end") >= F.col("released")))
    return (
        first.join(before, ["variable", "month"])
        .filter(valid)
        .groupBy("variable", "month", "now", "released")
        .agg(F.max_by("was", "realtime_start").alias("was"))
        .select("variable", F.col("month").alias("reference_month"), (100 * F.ln(F.try_divide("now", "was"))).alias("value"), F.to_date("released").alias("release_date"))
    )


def build(raw: dict[str, DataFrame], transforms: dict[str, str]) -> DataFrame:
    """All variables of a snapshot in one long table."""
    from functools import reduce

    made = [(monthly_mean if t == "monthly_mean" else real_time_growth)(raw[n].withColumn("variable", F.lit(n))) for n, t in transforms.items()]
    return reduce(DataFrame.unionByName, made)


def available_lags(monthly: DataFrame, months: DataFrame, n_lags: int) -> DataFrame:
    """(variable, month, lags, latest_reference_month) for every month of (month).

    A value counts in months that begin after its release day, so it is dealt to its
    first such month; months and values then meet in one ordered window of a
    variable (no range join).  lags holds the n_lags latest reference months, the
    latest first, or null if fewer are known.

    The window keeps, by month, the values first usable in it; a running list of
    them is cut to the latest n_lags, by reference month.
    """
    first = F.add_months(F.trunc("release_date", "MM"), 1)
    born = monthly.select("variable", first.alias("month"), F.struct(F.col("reference_month").alias("ref"), clean(F.col("value")).alias("value")).alias("v"))
    asked = monthly.select("variable").distinct().crossJoin(F.broadcast(months.select("month").distinct())).select("variable", "month", F.lit(True).alias("asked"))  # variables x months, the result's rows
    events = born.groupBy("variable", "month").agg(F.collect_list("v").alias("new")).join(asked, ["variable", "month"], "full")
    w = Window.partitionBy("variable").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    # Of each month at most n_lags values can ever be among the latest n_lags.
    newest = F.slice(F.sort_array("new", asc=False), 1, n_lags)
    known = F.slice(F.sort_array(F.flatten(F.collect_list(newest).over(w)), asc=False), 1, n_lags)
    return (
        events.withColumn("known", known)
        .filter("asked")
        .select("variable", "month", F.when(F.size("known") >= n_lags, F.transform("known", lambda r: r["value"])).alias("lags"), F.try_element_at("known", F.lit(1))["ref"].alias("latest_reference_month"))
    )


def daily_lags(days: DataFrame, lags: DataFrame, check: bool = True) -> DataFrame:
    """days with the lags of their month; raises if a month has none or too few."""
    j = days.withColumn("month", F.trunc("date", "MM")).join(lags.select("variable", "month", "lags"), "month", "left")
    if check:
        bad = j.filter(F.col("lags").isNull() | F.exists("lags", lambda v: v.isNull())).agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("m")).first()
        if bad["n"]:
            raise ValueError(f"No complete macro lags for {bad['n']} day(s), first in month {bad['m']}.")
    return j


def weighted(lagged: DataFrame, w: float, n_lags: int) -> DataFrame:
    """lagged with x, the beta-weighted sum of its lags."""
    return lagged.withColumn("x", dot(F.col("lags"), beta_weights(F.lit(float(w)), n_lags)))


def summary(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("variable").agg(F.count(F.lit(1)).alias("months"), F.min("reference_month").alias("first"), F.max("reference_month").alias("last"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
