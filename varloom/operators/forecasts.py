"""One-day-ahead VaR and ES forecasts: historical simulation, EWMA, GARCH family, FHS, GARCH-MIDAS.

Forecasts are (symbol, model, date, ret, sigma, var_*, es_*); a day's row uses
strictly earlier rows only.  Estimation is spread over (series, model, chain of refits)
rows, each carrying its own slice of the series: work is parallel within a series
too, and a refit starts from the one before it in its chain.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import volatility as vol
from varloom.functions.columns import level_name, series
from varloom.functions.recursion import backcast, ewma_next, gjr_variance, midas_components
from varloom.functions.shocks import quantile, tail_mean
from varloom.plans.config import ForecastSettings


def _columns(s: ForecastSettings) -> list[str]:
    return [*(f"var_{level_name(v)}" for v in s.var_levels), *(f"es_{level_name(v)}" for v in s.es_levels)]


def _schema(s: ForecastSettings) -> str:
    return "symbol string, model string, date date, ret double, sigma double, " + ", ".join(f"{c} double" for c in _columns(s))


def check_history(returns: DataFrame, start, end, window: int) -> None:
    """Raises unless every series has forecast dates and window earlier returns before the first."""
    n = F.row_number().over(series())
    rows = returns.withColumn("n", n).filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") <= F.lit(end).cast("date"))).groupBy("symbol").agg(F.min("n").alias("n"), F.min("date").alias("first"))
    worst = rows.orderBy("n").first()
    if worst is None:
        raise ValueError("No forecast dates in the requested period.")
    if worst["n"] - 1 < window:
        raise ValueError(f"The first forecast date {worst['first']} has only {worst['n'] - 1} earlier returns; the window needs {window}.")


def _period(df: DataFrame, start, end) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    return df if end is None else df.filter(F.col("date") <= F.lit(end).cast("date"))


def historical_simulation(returns: DataFrame, s: ForecastSettings, start=None, end=None) -> DataFrame:
    """Quantile (linear) and tail mean of the previous rows, by framed aggregates."""
    w = series()
    frame = w.rowsBetween(-s.historical_window, -1)
    alphas = {v: 1 - v for v in (*s.var_levels, *s.es_levels)}
    df = returns.select("symbol", "date", "ret", F.row_number().over(w).alias("n"), *(F.percentile("ret", F.lit(a)).over(frame).alias(f"q_{level_name(v)}") for v, a in alphas.items()), F.collect_list("ret").over(frame).alias("past"))
    df = _period(df.filter(F.col("n") > s.historical_window), start, end)

    def tail(v):
        below = F.filter("past", lambda r: r <= F.col(f"q_{level_name(v)}"))
        return F.aggregate(below, F.lit(0.0), lambda a, r: a + r) / F.size(below)

    return df.select(
        "symbol", F.lit(f"HS-{s.historical_window}").alias("model"), "date", "ret", F.lit(None).cast("double").alias("sigma"),
        *((-F.col(f"q_{level_name(v)}")).alias(f"var_{level_name(v)}") for v in s.var_levels), *((-tail(v)).alias(f"es_{level_name(v)}") for v in s.es_levels),
    )


def historical_simulation_grouped(returns: DataFrame, s: ForecastSettings, start=None, end=None) -> DataFrame:
    """The same by sorted numpy windows, for long panels: one series a group, windows in batches."""
    h, name, columns = s.historical_window, f"HS-{s.historical_window}", _columns(s)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r = pdf["ret"].to_numpy(float)
        out = {c: [] for c in columns}
        windows = np.lib.stride_tricks.sliding_window_view(r, h)[:-1] if len(r) > h else np.empty((0, h))
        for i in range(0, len(windows), 4096):
            part = windows[i : i + 4096]
            for v in s.var_levels:
                out[f"var_{level_name(v)}"].append(-np.quantile(part, 1 - v, axis=1))
            for v in s.es_levels:
                q = np.quantile(part, 1 - v, axis=1)[:, None]
                out[f"es_{level_name(v)}"].append(-np.where(part <= q, part, 0).sum(axis=1) / (part <= q).sum(axis=1))
        made = {c: np.concatenate(v) if v else np.empty(0) for c, v in out.items()}
        return pdf.iloc[h:][["symbol", "date", "ret"]].assign(model=name, sigma=np.nan, **made)[["symbol", "model", "date", "ret", "sigma", *columns]]

    return _period(returns.groupBy("symbol").applyInPandas(run, _schema(s)), start, end)


def _by_series(returns: DataFrame, run, schema: str) -> DataFrame:
    """run on the ordered frame of each series."""
    return returns.groupBy("symbol").applyInPandas(lambda pdf: run(pdf.sort_values("date")), schema)


def ewma(returns: DataFrame, s: ForecastSettings, start=None, end=None) -> DataFrame:
    """Zero-mean normal forecasts from an exponentially weighted variance of the whole history."""
    name = f"EWMA-{s.ewma_lambda:g}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after = ewma_next(pdf["ret"].to_numpy(float), s.ewma_lambda)
        return pdf.iloc[1:][["symbol", "date", "ret"]].assign(sigma=np.sqrt(after[:-1]))

    path = _by_series(returns.select("symbol", "date", "ret"), run, "symbol string, date date, ret double, sigma double")
    var = ((-F.col("sigma") * F.lit(quantile("normal", (), 1 - v))).alias(f"var_{level_name(v)}") for v in s.var_levels)
    es = ((-F.col("sigma") * F.lit(tail_mean("normal", (), 1 - v))).alias(f"es_{level_name(v)}") for v in s.es_levels)
    out = path.select("symbol", F.lit(name).alias("model"), "date", "ret", "sigma", *var, *es)
    first = Window.partitionBy("symbol").orderBy("date")
    # As many earlier returns as every other model has.
    return _period(out.withColumn("n", F.row_number().over(first)).filter(F.col("n") >= s.historical_window).drop("n"), start, end)


def gjr_path(returns: DataFrame, mu: float, omega: float, alpha: float, gamma: float, beta: float) -> DataFrame:
    """(symbol, date, ret, sigma2): the variance of each day under fixed parameters."""

    def run(pdf):
        y = pdf["ret"].to_numpy(float)
        return pdf[["symbol", "date", "ret"]].assign(sigma2=gjr_variance(y - mu, omega, alpha, gamma, beta, backcast(y - y.mean()))[0])

    return _by_series(returns.select("symbol", "date", "ret"), run, "symbol string, date date, ret double, sigma2 double")


def midas_path(lagged: DataFrame, mu: float, alpha: float, gamma: float, beta: float, m0: float, theta: float) -> DataFrame:
    """(symbol, date, ret, tau, g) of a MIDAS model with fixed parameters; lagged has x."""

    def run(pdf):
        y = pdf["ret"].to_numpy(float)
        tau, g = midas_components(y[None, :] - mu, (m0 + theta * pdf["x"].to_numpy(float))[None, :], [alpha], [gamma], [beta], [backcast(y - y.mean())])
        return pdf[["symbol", "date", "ret"]].assign(tau=tau[0], g=g[0])

    return _by_series(lagged.select("symbol", "date", "ret", "x"), run, "symbol string, date date, ret double, tau double, g double")


def normal_likelihood(path: DataFrame, mu: float) -> DataFrame:
    """(symbol, n, loglik) of a path of variances with normal shocks."""
    e = F.col("ret") - mu
    term = -0.5 * (math.log(2 * math.pi) + e * e / F.col("sigma2")) - 0.5 * F.ln("sigma2")
    return path.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(term).alias("loglik"))


# --- estimation ---

_FIT = "symbol string, model string, params map<string,double>, std_errors map<string,double>, loglik double, n_obs int, converged boolean, sigma2 array<double>, std_resid array<double>"


def _spec_rows(spark, specs) -> DataFrame:
    return spark.createDataFrame([(s.name, s.asymmetric, s.dist, s.lags) for s in specs], "model string, asymmetric boolean, dist string, lags int")


def fits(returns: DataFrame, specs=vol.SPECS, errors: bool = True) -> DataFrame:
    """In-sample fits: one row for each series and specification, fitted in parallel."""
    arrays = returns.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "ret"))), lambda r: r["ret"]).alias("y"))
    rows = arrays.crossJoin(F.broadcast(_spec_rows(returns.sparkSession, specs)))  # series x specifications
    n = _one_thread(returns.sparkSession)

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                f = vol.fit(np.asarray(r.y, float), vol.Spec(bool(r.asymmetric), r.dist), errors=errors)
                yield pd.DataFrame([{"symbol": r.symbol, "model": r.model, "params": f.params, "std_errors": {k: v for k, v in f.std_errors.items() if not math.isnan(v)}, "loglik": f.loglik, "n_obs": f.n_obs, "converged": f.converged, "sigma2": f.sigma2, "std_resid": f.std_resid}])

    return rows.repartition(n, "symbol", "model").mapInPandas(run, _FIT)


def fit_statistics(fitted: DataFrame) -> DataFrame:
    """AIC, BIC, persistence, half-life and unconditional variance of fits."""
    p = F.col("params")
    k = F.size("params")
    persistence = p["alpha"] + F.coalesce(p["gamma"], F.lit(0.0)) / 2 + p["beta"]
    return fitted.select(
        "symbol", "model", "loglik", "n_obs", "converged", k.alias("n_params"), (2 * k - 2 * F.col("loglik")).alias("aic"), (k * F.ln("n_obs") - 2 * F.col("loglik")).alias("bic"),
        persistence.alias("persistence"), F.try_divide(F.lit(math.log(0.5)), F.ln(persistence)).alias("half_life"), F.try_divide(p["omega"], 1 - persistence).alias("unconditional_variance"),
    )


def best(statistics: DataFrame) -> DataFrame:
    return statistics.groupBy("symbol").agg(F.min_by("model", "aic").alias("best_aic"), F.min_by("model", "bic").alias("best_bic"))


def parameter_table(fitted: DataFrame, models: list[str]) -> DataFrame:
    """Parameters by models: 'estimate (se)', 'estimate (at bound)' or '-'."""
    long = fitted.select("symbol", "model", F.explode("params").alias("param", "estimate"), "std_errors")
    se = F.col("std_errors")[F.col("param")]
    cell = F.when(se.isNull(), F.format_string("%.4f (at bound)", "estimate")).otherwise(F.format_string("%.4f (%.4f)", F.col("estimate"), se))
    wide = long.select("symbol", "param", "model", cell.alias("cell")).groupBy("symbol", "param").pivot("model", models).agg(F.first("cell"))
    return wide.select("symbol", "param", *(F.coalesce(F.col(f"`{m}`"), F.lit("-")).alias(m) for m in models))


def t_statistics(fitted: DataFrame) -> DataFrame:
    long = fitted.select("symbol", "model", F.explode("params").alias("param", "estimate"), "std_errors")
    se = F.col("std_errors")[F.col("param")]
    return long.select("symbol", "model", "param", "estimate", se.alias("robust_se"), F.try_divide(F.col("estimate"), se).alias("t_stat"))


#: Restricted model, full model, degrees of freedom.
NESTED = [
    ("GARCH(1,1)-normal", "GJR-GARCH(1,1)-normal", 1), ("GARCH(1,1)-t", "GJR-GARCH(1,1)-t", 1), ("GARCH(1,1)-skewt", "GJR-GARCH(1,1)-skewt", 1),
    ("GARCH(1,1)-t", "GARCH(1,1)-skewt", 1), ("GJR-GARCH(1,1)-t", "GJR-GARCH(1,1)-skewt", 1),
]


def likelihood_ratios(fitted: DataFrame, pairs=NESTED) -> DataFrame:
    from varloom.functions.columns import chi2_sf

    p = fitted.sparkSession.createDataFrame(pairs, "restricted string, full string, df int")
    a, b = fitted.select("symbol", F.col("model").alias("restricted"), F.col("loglik").alias("l0")), fitted.select("symbol", F.col("model").alias("full"), F.col("loglik").alias("l1"))
    lr = F.greatest(2 * (F.col("l1") - F.col("l0")), F.lit(0.0))
    return a.join(F.broadcast(p), "restricted").join(b, ["symbol", "full"]).select("symbol", "restricted", "full", lr.alias("lr"), "df", chi2_sf(lr, 1).alias("p_value"))


def residuals(fitted: DataFrame) -> DataFrame:
    """(symbol = series and model, date = position, x) of standardised residuals, for the diagnostics of returns."""
    return fitted.select(F.concat_ws("|", "symbol", "model").alias("symbol"), F.posexplode("std_resid").alias("date", "x"))


# --- rolling and expanding forecasts ---

#: Refits of one chain: the first starts cold, each other from the one before it.  Chains are parallel.
CHAIN = 25
_PARAMS = "symbol string, model string, refit int, date date, params map<string,double>, converged boolean, loglik double"


def _one_thread(spark) -> int:
    """Tasks for small fits, whose workers use one BLAS thread each, as every core has a task of its own."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _chains(df: DataFrame, keys: list[str], s: ForecastSettings, start, end, expanding: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chain, window, dates, y, more): the days that a chain of refits serves, after the window of the first of them.

    A row is all that a task needs; a series is copied once for each chain, not once a refit.
    """
    fields = ["date", "ret", *more]
    arrays = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("d"))
    d, days = F.col("d"), s.refit_every * CHAIN
    lo = F.lit(s.window) if start is None else F.greatest(F.lit(s.window), F.size(F.filter(d, lambda r: r["date"] < F.lit(start).cast("date"))))
    hi = F.size(d) if end is None else F.size(F.filter(d, lambda r: r["date"] <= F.lit(end).cast("date")))
    rows = arrays.withColumn("lo", lo).withColumn("hi", hi).filter("hi > lo").withColumn("first", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(days))))
    begin = F.lit(0) if expanding else F.col("first") - s.window
    part = F.slice(d, begin + 1, F.col("first") + F.least(F.lit(days), F.col("hi") - F.col("first")) - begin)
    made = rows.select(*keys, ((F.col("first") - F.col("lo")) / days).cast("int").alias("chain"), (F.col("first") - begin).alias("window"), part.alias("d"))
    return made.select(*keys, "chain", "window", *(F.col("d")[f].alias({"date": "dates", "ret": "y"}.get(f, f)) for f in fields))


def _refitted(chains: DataFrame, s: ForecastSettings, specs, expanding: bool, profiled: bool = True) -> DataFrame:
    """The refits of chains, which have symbol and, if one specification serves several models, model."""
    rows = chains.crossJoin(F.broadcast(_spec_rows(chains.sparkSession, specs).withColumnRenamed("model", "spec")))  # chains x specifications: the work list
    if "model" not in chains.columns:
        rows = rows.withColumn("model", F.col("spec"))
    n = _one_thread(chains.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                spec, y = vol.Spec(bool(r.asymmetric), r.dist, int(r.lags)), np.asarray(r.y, float)
                x = np.stack(r.x).astype(float) if spec.lags else None
                last = None
                for k, at in enumerate(range(r.window, len(y), s.refit_every)):
                    lo = 0 if expanding else at - r.window
                    try:
                        f = vol.fit(y[lo:at], spec, None if x is None else x[lo:at], warm=last, errors=False, profiled=profiled)
                        good = all(math.isfinite(v) for v in f.params.values())
                    except (ValueError, np.linalg.LinAlgError):
                        good = False
                    out.append({"symbol": r.symbol, "model": r.model, "refit": r.chain * CHAIN + k, "date": r.dates[at], "params": f.params if good else None, "converged": bool(good and f.converged), "loglik": f.loglik if good else None})
                    last = f if good else last
            if out:
                yield pd.DataFrame(out)

    fitted = rows.repartition(n, "symbol", "model", "chain").mapInPandas(run, _PARAMS)
    w = Window.partitionBy("symbol", "model").orderBy("refit").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last("params", ignorenulls=True).over(w)
    return fitted.withColumn("params", F.coalesce(kept, F.raise_error(F.concat(F.lit("the first fit failed: "), F.col("model"))).cast("map<string,double>")))


def refits(returns: DataFrame, s: ForecastSettings, specs=vol.SPECS, start=None, end=None, expanding: bool = False) -> DataFrame:
    """(symbol, model, refit, date, params, converged, loglik): one fit for each block of refit_every days.

    A failed fit has the parameters of the last one before it that did not fail.
    """
    return _refitted(_chains(returns, ["symbol"], s, start, end, expanding), s, specs, expanding)


def _with_params(chains: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """chains and, for each of their models, params: refit within the chain -> parameters."""
    at = F.col("refit")
    by_chain = params.groupBy("symbol", "model", (at / CHAIN).cast("int").alias("chain")).agg(F.map_from_entries(F.collect_list(F.struct(at % CHAIN, "params"))).alias("params"))
    return chains.join(by_chain, keys)


def _risks(s: ForecastSettings, mu: float, sigma: float, q: dict, es: dict) -> dict:
    return {f"var_{level_name(v)}": -(mu + sigma * q[v]) for v in s.var_levels} | {f"es_{level_name(v)}": -(mu + sigma * es[v]) for v in s.es_levels}


def _tails(spec: vol.Spec, p: dict, s: ForecastSettings) -> tuple[dict, dict]:
    """Quantiles and tail means of the standardised shock by level."""
    got = vol.tails(spec, p, {1 - v for v in (*s.var_levels, *s.es_levels)})
    return {v: got[1 - v][0] for v in s.var_levels}, {v: got[1 - v][1] for v in s.es_levels}


def garch_forecasts(returns: DataFrame, s: ForecastSettings, params: DataFrame, start=None, end=None, expanding: bool = False, fhs: str | None = None) -> DataFrame:
    """Forecasts of each block's days under its refit's parameters (from :func:`refits`).

    fhs names the model whose variance also drives filtered historical
    simulation (model FHS-GJR): its window's standardised residuals in place of a
    distribution.
    """
    rows = _with_params(_chains(returns, ["symbol"], s, start, end, expanding), params, ["symbol", "chain"])
    columns = _columns(s)
    by_name = {x.name: x for x in vol.SPECS}
    n = _one_thread(returns.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                spec, y = by_name[r.model], np.asarray(r.y, float)
                for k, p in dict(r.params).items():
                    first = r.window + k * s.refit_every
                    days = range(first, min(first + s.refit_every, len(y)))
                    if not days:
                        continue  # parameters for days that the series does not have
                    p = dict(p)
                    q, es = _tails(spec, p, s)
                    # Windows of one length are one batch.
                    samples = [y[None, :i] for i in days] if expanding else [np.stack([y[i - r.window : i] for i in days])]
                    paths = [vol.next_variances(p, spec, x) for x in samples]
                    for i, s2, z in zip(days, np.concatenate([a for a, _ in paths]), (row for _, b in paths for row in b), strict=True):
                        sigma = math.sqrt(s2)
                        row = {"symbol": r.symbol, "model": r.model, "date": r.dates[i], "ret": y[i], "sigma": sigma}
                        out.append(row | _risks(s, p["mu"], sigma, q, es))
                        if r.model == fhs:
                            cut = {v: float(np.quantile(z, 1 - v)) for v in (*s.var_levels, *s.es_levels)}
                            out.append(row | {"model": "FHS-GJR"} | _risks(s, p["mu"], sigma, cut, {v: z[z <= cut[v]].mean() for v in s.es_levels}))
            if out:
                yield pd.DataFrame(out)[["symbol", "model", "date", "ret", "sigma", *columns]]

    return rows.repartition(n, "symbol", "model", "chain").mapInPandas(run, _schema(s))


def midas_forecasts(lagged: DataFrame, s: ForecastSettings, n_lags: int, dist: str = "skewt", start=None, end=None, expanding: bool = True, profiled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(forecasts, params) of GARCH-MIDAS, model MIDAS-variable; lagged is (symbol, variable, date, ret, lags).

    Within a chain of refits, each and its lag-shape profile start from the one before.
    """
    spec, columns = vol.Spec(True, dist, n_lags), _columns(s)
    days = lagged.select("symbol", F.concat(F.lit("MIDAS-"), "variable").alias("model"), "date", "ret", F.col("lags").alias("x"))
    chains = _chains(days, ["symbol", "model"], s, start, end, expanding, ("x",))
    params = _refitted(chains, s, [spec], expanding, profiled)
    n = _one_thread(lagged.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                y, x = np.asarray(r.y, float), np.stack(r.x).astype(float)
                for k, p in dict(r.params).items():
                    p = dict(p)
                    q, es = _tails(spec, p, s)
                    first = r.window + k * s.refit_every
                    for i in range(first, min(first + s.refit_every, len(y))):
                        lo = 0 if expanding else i - r.window
                        sigma = math.sqrt(vol.next_variance(p, spec, y[lo:i], x[lo:i], x[i]))
                        out.append({"symbol": r.symbol, "model": r.model, "date": r.dates[i], "ret": y[i], "sigma": sigma} | _risks(s, p["mu"], sigma, q, es))
            if out:
                yield pd.DataFrame(out)[["symbol", "model", "date", "ret", "sigma", *columns]]

    rows = _with_params(chains, params, ["symbol", "model", "chain"]).repartition(n, "symbol", "model", "chain")
    return rows.mapInPandas(run, _schema(s)), params.select("symbol", "model", "date", "params", "converged", "loglik")


def theta_summary(params: DataFrame) -> DataFrame:
    """First, median, last and share positive of theta over the refits."""
    t = F.col("params")["theta"]
    return params.withColumn("theta", t).groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("refits"), F.count_if(~F.col("converged")).alias("not_converged"), F.min_by("theta", "date").alias("first"), F.percentile("theta", F.lit(0.5)).alias("median"), F.max_by("theta", "date").alias("last"), F.avg(F.when(F.col("theta") > 0, 1.0).otherwise(0.0)).alias("positive"))


def refit_summary(params: DataFrame) -> DataFrame:
    return params.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("refits"), F.count_if(~F.col("converged")).alias("failed"))


def forecast_summary(forecasts: DataFrame, s: ForecastSettings) -> DataFrame:
    """Mean VaR and ES and exception rates by model, in one aggregation."""
    out = []
    for v in s.var_levels:
        c = F.col(f"var_{level_name(v)}")
        out += [F.avg(c).alias(f"mean_var_{level_name(v)}"), F.avg(F.when(-F.col("ret") > c, 1.0).otherwise(0.0)).alias(f"rate_{level_name(v)}")]
    out += [F.avg(f"es_{level_name(v)}").alias(f"mean_es_{level_name(v)}") for v in s.es_levels]
    return forecasts.groupBy("symbol", "model").agg(F.count(F.lit(1)).alias("days"), *out)
