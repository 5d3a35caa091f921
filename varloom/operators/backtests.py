"""Coverage and tail backtests of (symbol, model, date, ret, var_*, es_*) forecasts, in long form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.columns import chi2_sf, hit, level_name, lr_coverage, lr_independence, ratio
from varloom.functions.resampling import studentised_p

WINDOW, YELLOW, RED = 250, 5, 10
SIGNIFICANCE = 0.05
KEYS = ("symbol", "model", "level")


def hits(forecasts: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(symbol, model, level, date, hit): one row for each forecast and level."""
    rows = F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"var_{level_name(v)}").alias("var")) for v in levels))
    return forecasts.select("symbol", "model", "date", "ret", F.explode(rows).alias("r")).select("symbol", "model", "r.level", "date", hit(F.col("ret"), F.col("r.var")).alias("hit"))


def _order() -> Window:
    return Window.partitionBy(*KEYS).orderBy("date")


def _by_level(levels, f):
    """f(1 - level) as an expression over the level column; alpha is computed in Python floats."""
    out = F.lit(None).cast("double")
    for v in levels:
        out = F.when(F.col("level") == F.lit(v), f(1 - v)).otherwise(out)
    return out


def coverage(h: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Kupiec and Christoffersen tests, every series, model and level in one aggregation."""
    prev = F.lag("hit").over(_order())
    t = h.withColumn("prev", prev)
    on, was = F.col("hit"), F.col("prev")
    s = t.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(on).alias("exceptions"), F.count_if(~was & ~on).alias("n00"), F.count_if(~was & on).alias("n01"), F.count_if(was & ~on).alias("n10"), F.count_if(was & on).alias("n11")
    )
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    s = (
        s.withColumn("rate", ratio(F.col("exceptions"), F.col("n")))
        .withColumn("expected", _by_level(levels, lambda a: F.col("n") * F.lit(a)))
        .withColumn("lr_uc", _by_level(levels, lambda a: lr_coverage(F.col("n"), F.col("exceptions"), a)))
        .withColumn("pi01", ratio(n01, n00 + n01))
        .withColumn("pi11", ratio(n11, n10 + n11))
        .withColumn("lr_ind", lr_independence(n00, n01, n10, n11))
    )
    s = s.withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))
    return s.withColumn("p_uc", chi2_sf(F.col("lr_uc"), 1)).withColumn("p_ind", chi2_sf(F.col("lr_ind"), 1)).withColumn("p_cc", chi2_sf(F.col("lr_cc"), 2))


def rolling_exceptions(h: DataFrame, window: int = WINDOW) -> DataFrame:
    """(…, date, exceptions) in each full window of days."""
    w = _order()
    return (
        h.withColumn("exceptions", F.sum(F.col("hit").cast("int")).over(w.rowsBetween(1 - window, 0)))
        .withColumn("i", F.row_number().over(w))
        .filter(F.col("i") >= window)
        .select(*KEYS, "date", "exceptions")
    )


def traffic_light(h: DataFrame, window: int = WINDOW) -> DataFrame:
    """Shares of full windows in each zone and the worst one."""
    c = F.col("exceptions")
    share = lambda p: F.avg(F.when(p, 1.0).otherwise(0.0))
    return rolling_exceptions(h, window).groupBy(*KEYS).agg(share(c < YELLOW).alias("green"), share((c >= YELLOW) & (c < RED)).alias("yellow"), share(c >= RED).alias("red"), F.max("exceptions").alias("max_exceptions"))


def var_table(forecasts: DataFrame, levels: tuple[float, ...], window: int = WINDOW) -> DataFrame:
    """Coverage of every model and level; traffic-light columns at 99 % only."""
    h = hits(forecasts, levels)
    zones = traffic_light(h.filter(F.abs(F.col("level") - 0.99) < 1e-8), window)
    return coverage(h, levels).join(zones, list(KEYS), "left")


def es_terms(forecasts: DataFrame, level: float) -> DataFrame:
    """(symbol, model, level, date, z2_term, residual): residual is null off exception days."""
    v, e, loss = F.col(f"var_{level_name(level)}"), F.col(f"es_{level_name(level)}"), -F.col("ret")
    on = hit(F.col("ret"), v)
    return forecasts.select(
        "symbol", "model", F.lit(level).alias("level"), "date", F.when(on, loss / (F.lit(1 - level) * e)).otherwise(0.0).alias("z2_term"), F.when(on, loss / e - 1).alias("residual")
    )


def es_stats(forecasts: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Z2 and the mean exceedance residual (null under two exceptions), without p-values."""
    from functools import reduce

    terms = reduce(DataFrame.unionByName, [es_terms(forecasts, v) for v in levels])
    n = F.count("residual")
    return terms.groupBy(*KEYS).agg((1 - F.avg("z2_term")).alias("z2"), n.alias("n_exceptions"), F.when(n >= 2, F.avg("residual")).alias("mean_residual"))


def es_table(forecasts: DataFrame, levels: tuple[float, ...], reps: int = 4999, seed: int = 0) -> DataFrame:
    """es_stats with bootstrap p-values.

    A group is one statistic's days, as an array: bounded by the length of a
    forecast series, not by the table.
    """
    from functools import reduce

    terms = reduce(DataFrame.unionByName, [es_terms(forecasts, v) for v in levels])
    arrays = terms.groupBy(*KEYS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "z2_term", "residual"))), lambda r: F.struct(r["z2_term"], r["residual"])).alias("days")
    )

    def run(batches):
        for pdf in batches:
            z, r = [], []
            for days in pdf["days"]:
                term = np.array([d["z2_term"] for d in days], float)
                left = np.array([d["residual"] for d in days if d["residual"] is not None], float)
                left = left[~np.isnan(left)]
                z.append(studentised_p(term - 1.0, reps, seed))
                r.append(studentised_p(left, reps, seed) if len(left) >= 2 else None)
            yield pdf[list(KEYS)].assign(p_z2=z, p_residual=r)

    p = arrays.mapInPandas(run, "symbol string, model string, level double, p_z2 double, p_residual double")
    return es_stats(forecasts, levels).join(p, list(KEYS))


def verdicts(var: DataFrame, es: DataFrame | None = None) -> DataFrame:
    """(symbol, model, test, level, p_value, verdict): a missing p-value counts as a rejection."""
    tests = var.select("symbol", "model", "level", F.explode(F.array(*(F.struct(F.lit(n).alias("test"), F.col(p).alias("p_value")) for n, p in (("Kupiec", "p_uc"), ("independence", "p_ind"), ("conditional coverage", "p_cc"))))).alias("t"))
    if es is not None:
        tests = tests.unionByName(es.select("symbol", "model", "level", F.explode(F.array(*(F.struct(F.lit(n).alias("test"), F.col(p).alias("p_value")) for n, p in (("Z2", "p_z2"), ("McNeil-Frey", "p_residual"))))).alias("t")))
    passed = F.coalesce(F.nanvl(F.col("t.p_value"), F.lit(-1.0)) >= SIGNIFICANCE, F.lit(False))
    return tests.select("symbol", "model", "t.test", "level", "t.p_value", F.when(passed, "pass").otherwise("REJECT").alias("verdict"))


def rejections(v: DataFrame) -> DataFrame:
    return v.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("verdict") == "REJECT").alias("rejections"))
