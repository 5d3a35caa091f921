"""Forecast losses in long form, their ranking, Diebold-Mariano tests and the Model Confidence Set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.columns import fz0_loss, level_name, qlike, squared_error, tick_loss, two_sided_p
from varloom.functions.resampling import confidence_set


def _levels(levels, name) -> list[tuple[str, float]]:
    return [(name.format(f"{100 * v:.1f}%"), v) for v in levels]


def risk_losses(forecasts: DataFrame, var_levels: tuple[float, ...], es_levels: tuple[float, ...]) -> DataFrame:
    """(symbol, loss, model, date, value): tick and FZ0 losses, all in one scan."""
    rows = [F.struct(F.lit(n).alias("loss"), tick_loss(F.col("ret"), F.col(f"var_{level_name(v)}"), 1 - v).alias("value")) for n, v in _levels(var_levels, "VaR {}, tick loss")]
    rows += [F.struct(F.lit(n).alias("loss"), fz0_loss(F.col("ret"), F.col(f"var_{level_name(v)}"), F.col(f"es_{level_name(v)}"), 1 - v).alias("value")) for n, v in _levels(es_levels, "VaR and ES {}, FZ0 loss")]
    return forecasts.select("symbol", "model", "date", F.explode(F.array(*rows)).alias("r")).select("symbol", "r.loss", "model", "date", "r.value")


def variance_models(forecasts: DataFrame) -> DataFrame:
    """(symbol, model) with a variance forecast of its own.

    A model with a missing sigma has none; one whose sigmas are all close to
    those of a model of lower order (first date, then name) shares it.  Pairs are
    of models, never of days: each day's sigmas meet by an equi-join on the date.
    """
    s = forecasts.select("symbol", "model", "date", F.nanvl("sigma", F.lit(None).cast("double")).alias("sigma"))
    own = s.groupBy("symbol", "model").agg(F.count_if(F.col("sigma").isNull()).alias("missing"), F.count(F.lit(1)).alias("days")).filter("missing = 0")
    s = s.join(own.select("symbol", "model", "days"), ["symbol", "model"])
    a, b = s.alias("a"), s.alias("b")
    far = F.abs(F.col("a.sigma") - F.col("b.sigma")) - (1e-8 + 1e-5 * F.abs(F.col("b.sigma")))
    same = (
        a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.date") == F.col("b.date")) & (F.col("b.model") < F.col("a.model")))
        .groupBy(F.col("a.symbol").alias("symbol"), F.col("a.model").alias("model"), F.col("b.model").alias("other"))
        .agg(F.max(far).alias("far"), F.count(F.lit(1)).alias("met"), F.max("a.days").alias("days"))
        .filter("far <= 0 and met = days")
        .select("symbol", "model")
        .distinct()
    )
    return own.select("symbol", "model").join(same, ["symbol", "model"], "left_anti")


def variance_losses(forecasts: DataFrame, proxies: DataFrame, main: str, robustness: tuple[str, ...] = ()) -> DataFrame:
    """QLIKE against every proxy and MSE against the main one, for models with an own variance; a missing proxy day is an error."""
    f = forecasts.join(variance_models(forecasts), ["symbol", "model"]).select("symbol", "model", "date", (F.col("sigma") * F.col("sigma")).alias("s2"))
    columns = [main, *robustness]
    j = f.join(proxies.select("symbol", "date", *(F.col(c).alias(f"proxy_{c}") for c in columns)), ["symbol", "date"], "left")
    proxy = {c: F.coalesce(F.col(f"proxy_{c}"), F.raise_error(F.lit(f"no {c} on a forecast day")).cast("double")) for c in columns}
    rows = [F.struct(F.lit(f"variance, QLIKE vs {c}").alias("loss"), qlike(F.col("s2"), proxy[c]).alias("value")) for c in columns]
    rows.append(F.struct(F.lit(f"variance, MSE vs {main}").alias("loss"), squared_error(F.col("s2"), proxy[main]).alias("value")))
    return j.select("symbol", "model", "date", F.explode(F.array(*rows)).alias("r")).select("symbol", "r.loss", "model", "date", "r.value")


def ranked(losses: DataFrame, benchmark: str | None = None) -> DataFrame:
    """Mean loss, rank (ties share the truncated mean rank) and the change against the benchmark."""
    m = losses.groupBy("symbol", "loss", "model").agg(F.avg("value").alias("mean_loss"), F.count("value").alias("days"))
    w = Window.partitionBy("symbol", "loss")
    ties = F.count(F.lit(1)).over(Window.partitionBy("symbol", "loss", "mean_loss"))
    out = m.withColumn("rank", F.floor(F.rank().over(w.orderBy("mean_loss")) + (ties - 1) / 2))
    base = F.max(F.when(F.col("model") == benchmark, F.col("mean_loss"))).over(w) if benchmark else F.lit(None).cast("double")
    return out.withColumn("vs_benchmark", F.try_divide(F.col("mean_loss"), base) - 1)


def against(losses: DataFrame, benchmark: str) -> DataFrame:
    """(symbol, loss, model, date, diff): the loss less the benchmark's of the day."""
    base = F.max(F.when(F.col("model") == benchmark, F.col("value"))).over(Window.partitionBy("symbol", "loss", "date"))
    return losses.withColumn("diff", F.col("value") - base).filter(F.col("model") != benchmark).select("symbol", "loss", "model", "date", "diff")


def cumulative(losses: DataFrame, benchmark: str) -> DataFrame:
    w = Window.partitionBy("symbol", "loss", "model").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return against(losses, benchmark).withColumn("cumulative", F.sum("diff").over(w)).drop("diff")


def newey_west_lags(n: int) -> int:
    return int(np.floor(4 * (n / 100) ** (2 / 9)))


def diebold_mariano(losses: DataFrame, benchmark: str) -> DataFrame:
    """Mean difference, Newey-West t and p of every model against the benchmark.

    The number of lags follows each series' length.  A series' differences are one
    array, so that products of any lag need no window of their own; it is bounded
    by the length of a forecast series.
    """
    keys = ["symbol", "loss", "model"]
    days = against(losses, benchmark).filter("diff is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "diff"))).alias("d"), F.avg("diff").alias("mean_diff"), F.count("diff").cast("int").alias("n"))
    u = days.select(*keys, "mean_diff", "n", F.transform("d", lambda r: r["diff"] - F.col("mean_diff")).alias("u"), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int").alias("lags"))

    def product(k):
        pairs = F.zip_with(F.slice("u", k + 1, F.col("n") - k), F.slice("u", F.lit(1), F.col("n") - k), lambda a, b: a * b)
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    reach = F.least(F.col("lags"), F.col("n") - 1)
    weighted = F.when(reach >= 1, F.aggregate(F.sequence(F.lit(1), reach), F.lit(0.0), lambda s, k: s + 2 * (1 - k / (F.col("lags") + 1)) * product(k))).otherwise(0.0)
    se = F.sqrt((product(F.lit(0)) + weighted) / F.col("n") / F.col("n"))
    out = u.select(*keys, "mean_diff", se.alias("se"), "lags").withColumn("t_stat", F.when(F.col("se") > 0, F.col("mean_diff") / F.col("se")))
    return out.select(*keys, "mean_diff", "t_stat", two_sided_p(F.col("t_stat")).alias("p_value"), "lags")


def model_confidence_set(losses: DataFrame, confidence: float = 0.9, block: float = 10, reps: int = 10_000, seed: int = 0) -> DataFrame:
    """(symbol, loss, model, mean_loss, mcs_p, in_mcs, eliminated).

    Days become arrays, one row for each loss: days x models, bounded by the
    length of a forecast series.  A day has to have every model.
    """
    order = losses.groupBy("symbol", "loss").agg(F.sort_array(F.collect_set("model")).alias("models"))
    days = losses.groupBy("symbol", "loss", "date").agg(F.transform(F.sort_array(F.collect_list(F.struct("model", "value"))), lambda r: r["value"]).alias("v"))
    groups = days.groupBy("symbol", "loss").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "v"))), lambda r: r["v"]).alias("days")).join(order, ["symbol", "loss"])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for symbol, loss, rows, models in zip(pdf["symbol"], pdf["loss"], pdf["days"], pdf["models"], strict=True):
                found = confidence_set(np.array([np.asarray(r, float) for r in rows]), confidence, block, reps, seed)
                yield pd.DataFrame([{"symbol": symbol, "loss": loss, "model": models[f["position"]], **{k: f[k] for k in ("mean_loss", "mcs_p", "in_mcs", "eliminated")}} for f in found])

    return groups.mapInPandas(run, "symbol string, loss string, model string, mean_loss double, mcs_p double, in_mcs boolean, eliminated int")


def comparison(losses: DataFrame, benchmark: str, **mcs) -> DataFrame:
    """Ranks, tests against the benchmark and the confidence set, side by side."""
    keys = ["symbol", "loss", "model"]
    return ranked(losses, benchmark).join(diebold_mariano(losses, benchmark).select(*keys, "t_stat", "p_value"), keys, "left").join(model_confidence_set(losses, **mcs).select(*keys, "mcs_p", "in_mcs"), keys)


def loss_matrix(losses: DataFrame, loss: str, models: list[str]) -> DataFrame:
    """One column for each model; the list is given, so no extra job finds it."""
    return losses.filter(F.col("loss") == loss).groupBy("symbol", "date").pivot("model", models).agg(F.first("value"))


def rank_matrix(compared: DataFrame, losses: list[str]) -> DataFrame:
    """Models by losses: the rank, starred in the confidence set, '-' where a model has no such loss."""
    cell = F.concat(F.col("rank").cast("string"), F.when(F.col("in_mcs"), " *").otherwise(""))
    wide = compared.withColumn("cell", cell).groupBy("symbol", "model").pivot("loss", losses).agg(F.first("cell"))
    return wide.select("symbol", "model", *(F.coalesce(F.col(f"`{n}`"), F.lit("-")).alias(n) for n in losses))


def paired(development: DataFrame, locked: DataFrame, column: str) -> DataFrame:
    """'dev -> test' cells by loss and model."""
    keys = ["symbol", "loss", "model"]
    a, b = development.select(*keys, F.col(column).cast("string").alias("a")), locked.select(*keys, F.col(column).cast("string").alias("b"))
    return a.join(b, keys, "full").select(*keys, F.concat_ws(" -> ", F.coalesce("a", F.lit("-")), F.coalesce("b", F.lit("-"))).alias(column))


def decision(compared: DataFrame, benchmark: str, significance: float = 0.05) -> DataFrame:
    """supported: a lower mean loss than the benchmark's and a significant test."""
    base = F.max(F.when(F.col("model") == benchmark, F.col("mean_loss"))).over(Window.partitionBy("symbol", "loss"))
    found = F.coalesce((F.col("mean_loss") < F.col("base")) & (F.col("p_value") < significance), F.lit(False))
    return compared.withColumn("base", base).filter(F.col("model") != benchmark).withColumn("verdict", F.when(found, "supported").otherwise("not supported")).drop("base")
