import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from varloom.functions import columns, special
from varloom.functions import volatility as vol
from varloom.operators import backtests, forecasts, losses, macro, quality, returns, stylized
from varloom.plans.config import ForecastSettings

DAY = dt.date(2020, 1, 1)
SMALL = ForecastSettings(window=300, refit_every=7, historical_window=100)


def days(n, start=DAY):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.fixture(scope="module")
def series():
    return vol.simulate(340, vol.Spec(True, "t"), {"mu": 0.05, "omega": 0.05, "alpha": 0.05, "gamma": 0.1, "beta": 0.85, "nu": 6.0}, 1)


def frame(spark, y, symbol="A"):
    return spark.createDataFrame([(symbol, d, float(v)) for d, v in zip(days(len(y)), y)], "symbol string, date date, ret double")


def one(df):
    return df.collect()[0].asDict()


def test_price_formulas(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(days=i), 100.0, 110.0, 100.0, c) for i, c in enumerate((100.0, 110.0, 99.0))], "symbol string, date date, open double, high double, low double, close double")
    rows = returns.returns_and_proxies(df).orderBy("date").collect()
    assert [r["ret"] for r in rows] == pytest.approx([9.531018, -10.536052], abs=1e-6)
    assert rows[0]["parkinson"] == pytest.approx(32.763714, abs=1e-6)
    gk = spark.range(1).select(columns.garman_klass(F.lit(100.0), F.lit(110.0), F.lit(95.0), F.lit(105.0)).alias("v")).first()["v"]
    assert gk == pytest.approx(98.267233, abs=1e-6)


def bars(spark, n=60, **defect):
    """Clean bars with a dividend on day 30; defect maps a row to changed columns."""
    rng = np.random.default_rng(42)
    rows, close = [], 100.0
    for i, d in enumerate(days(n)):
        open_ = close * math.exp(rng.normal(0, 0.002))
        close = open_ * math.exp(rng.normal(0, 0.008))
        factor = 1.0 if i >= 30 else 0.985
        row = {"symbol": "A", "date": d, "open": open_, "high": max(open_, close) * 1.004, "low": min(open_, close) * 0.996, "close": close, "volume": 5_000_000, "adj_close": close * factor, "div_cash": 1.5 if i == 30 else 0.0, "split_factor": 1.0}
        rows.append(row | defect.get(f"row{i}", {}))
    return spark.createDataFrame(pd.DataFrame(rows), "symbol string, date date, open double, high double, low double, close double, volume bigint, adj_close double, div_cash double, split_factor double")


def found(df, **k):
    return [(r["date"], r["check"], r["detail"]) for r in quality.findings(df, **k).collect()]


def test_clean_bars_have_no_findings(spark):
    assert found(bars(spark)) == []


@pytest.mark.parametrize(
    "change,check",
    [
        ({"open": None}, {"missing_value"}), ({"open": float("nan")}, {"missing_value"}), ({"volume": 0}, {"zero_volume"}), ({"low": 0.0}, {"non_positive_price"}), ({"low": 1000.0}, {"ohlc_inconsistent"}),
        ({"open": 100.0, "high": 100.0, "low": 100.0, "close": 100.0, "adj_close": 98.5}, {"flat_bar"}), ({"div_cash": 2.0}, {"adjustment_missing"}),
    ],
)
def test_each_defect_is_found(spark, change, check):
    got = found(bars(spark, row10=change), large_move=0.5)
    assert {c for _, c, _ in got} == check
    assert {d for d, _, _ in got} == {DAY + dt.timedelta(days=10)}


def test_large_moves_and_zero_prices(spark):
    moved = found(bars(spark, row10={"adj_close": 200.0, "close": 203.045685}))
    assert [c for _, c, _ in moved if c == "large_move"] == ["large_move"] * 2
    zero = found(bars(spark, row10={"adj_close": 0.0}))
    assert [d for _, c, d in zero if c == "large_move"] == ["daily log return of -inf%", "daily log return of +inf%"]


def test_duplicates_and_calendar(spark):
    b = bars(spark, 10)
    twice = b.unionByName(b.filter(F.col("date") == DAY))
    assert [(d, c) for d, c, _ in found(twice)] == [(DAY, "duplicate_date")]
    calendar = spark.createDataFrame([(d,) for d in days(11)[1:]], "date date")
    got = found(b, calendar=calendar)
    assert [(d, c) for d, c, _ in got] == [(DAY, "not_a_trading_day"), (DAY + dt.timedelta(days=10), "missing_trading_day")]


def test_common_factor(spark):
    b = bars(spark, 5)
    full = b.select("*", F.col("open").alias("adj_open"), F.col("high").alias("adj_high"), F.col("low").alias("adj_low"))
    with pytest.raises(ValueError, match="different adjustment factors on 5 day"):
        returns.check_common_factor(full)
    returns.check_common_factor(full.withColumn("adj_close", F.col("close")))
    with pytest.raises(ValueError, match="missing columns"):
        returns.check_common_factor(b)


def test_facts_equal_numpy(spark, series):
    df = frame(spark, series)
    y = np.asarray(series)
    s = one(stylized.distribution_summary(df))
    assert (s["mean"], s["sd"]) == pytest.approx((y.mean(), y.std(ddof=1)))
    z = (y - y.mean()) / y.std()
    assert (s["skew"], s["kurt"]) == pytest.approx(((z**3).mean(), (z**4).mean() - 3))
    u = y - y.mean()
    rho = [(u[k:] @ u[:-k]) / (u @ u) for k in range(1, 21)]
    q = {m: len(y) * (len(y) + 2) * sum(r * r / (len(y) - k) for k, r in enumerate(rho[:m], 1)) for m in (5, 10, 20)}
    for r in stylized.ljung_box(df).collect():
        assert r["q"] == pytest.approx(q[r["lag"]])
        assert r["p_value"] == pytest.approx(special.chi2_sf(q[r["lag"]], r["lag"]), abs=1e-9)
    e = u**2
    x = np.column_stack([np.ones(len(e) - 5), *(e[5 - k : -k] for k in range(1, 6))])
    resid = e[5:] - x @ np.linalg.lstsq(x, e[5:], rcond=None)[0]
    lm = len(resid) * (1 - (resid @ resid) / ((e[5:] - e[5:].mean()) ** 2).sum())
    assert one(stylized.arch_lm(df))["lm"] == pytest.approx(lm)


def test_leverage_by_hand(spark):
    df = spark.createDataFrame([("A", d, r, p) for d, r, p in zip(days(5), (-1.0, 1.0, -1.0, 1.0, 0.0), (0.0, 5.0, 1.0, 9.0, 1.0))], "symbol string, date date, ret double, sq_ret double")
    row = one(stylized.leverage(df, size=2.0).filter("moves = 'all days'"))
    assert (row["after_down"], row["after_up"], row["ratio"]) == (7.0, 1.0, 7.0)


def test_sample_counts_are_checked(spark, series):
    df = frame(spark, series)
    fits = (("2020-06-01", "2020-08-31"), ("2020-09-01", "2020-12-31"))
    assert stylized.check_sample_fits(df, *fits, window=100)[0]["development"] == 92
    with pytest.raises(ValueError, match="precede"):
        stylized.check_sample_fits(df, *fits, window=1000)
    with pytest.raises(ValueError, match="No data"):
        stylized.check_sample_fits(df, ("2020-06-01", "2020-08-31"), ("2030-01-01", "2031-01-01"), window=10)


def test_erfc_is_exact(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(columns.erfc(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in got] == pytest.approx([math.erfc(x) for x in xs], abs=1e-13)


# --- forecasts ---


def by_date(df):
    return {r["date"]: r for r in df.collect()}


def test_historical_simulation_both_ways(spark, series):
    df = frame(spark, series)
    a, b = by_date(forecasts.historical_simulation(df, SMALL)), by_date(forecasts.historical_simulation_grouped(df, SMALL))
    assert len(a) == len(b) == len(series) - 100
    for i in (100, 200, 339):
        past, d = np.asarray(series[i - 100 : i]), days(340)[i]
        q = np.quantile(past, 1 - 0.975)
        assert a[d]["var_97_5"] == pytest.approx(-q) == b[d]["var_97_5"]
        assert a[d]["es_97_5"] == pytest.approx(-past[past <= q].mean())
        assert b[d]["es_97_5"] == pytest.approx(a[d]["es_97_5"])


def test_ewma_equals_the_loop(spark, series):
    got = by_date(forecasts.ewma(frame(spark, series), SMALL))
    w = 0.94 ** np.arange(75)
    v = (w * series[:75] ** 2).sum() / w.sum()
    for d, r in zip(days(340), series):
        if d in got:
            assert got[d]["sigma"] == pytest.approx(math.sqrt(v))
            assert got[d]["var_99"] == pytest.approx(-math.sqrt(v) * special.norm_ppf(1 - 0.99))
        v = 0.94 * v + 0.06 * r * r
    assert len(got) == 240


@pytest.fixture(scope="module")
def rolled(spark, series):
    df = frame(spark, series)
    params = forecasts.refits(df, SMALL, vol.SPECS[3:5]).cache()
    return params, forecasts.garch_forecasts(df, SMALL, params, fhs="GJR-GARCH(1,1)-normal").cache()


def test_rolling_forecasts(spark, series, rolled):
    params, f = rolled
    assert {r["model"]: r["n"] for r in f.groupBy("model").agg(F.count("*").alias("n")).collect()} == {"GJR-GARCH(1,1)-normal": 40, "GJR-GARCH(1,1)-t": 40, "FHS-GJR": 40}
    assert params.count() == 2 * math.ceil(40 / 7)
    p = dict(params.filter("model = 'GJR-GARCH(1,1)-t' and refit = 0").first()["params"])
    first = by_date(f.filter("model = 'GJR-GARCH(1,1)-t'"))[days(340)[302]]
    spec = vol.SPECS[4]
    sigma = math.sqrt(vol.next_variance(p, spec, series[2:302]))
    q = vol.tails(spec, p, [1 - 0.99])[1 - 0.99][0]
    assert first["sigma"] == pytest.approx(sigma)
    assert first["var_99"] == pytest.approx(-(p["mu"] + sigma * q))


def test_chains_of_any_length_give_the_same_days(spark, series, rolled, monkeypatch):
    monkeypatch.setattr(forecasts, "CHAIN", 2)
    df, spec = frame(spark, series), vol.SPECS[4:5]
    params = forecasts.refits(df, SMALL, spec).cache()
    assert [r["refit"] for r in params.orderBy("refit").collect()] == list(range(6))
    got, whole = by_date(forecasts.garch_forecasts(df, SMALL, params)), by_date(rolled[1].filter("model = 'GJR-GARCH(1,1)-t'"))
    assert got.keys() == whole.keys()
    for d, r in got.items():
        assert r["sigma"] == pytest.approx(whole[d]["sigma"], rel=1e-3)


def test_no_look_ahead(spark, series, rolled):
    changed = np.array(series)
    changed[320:] *= 5
    df = frame(spark, changed)
    again = forecasts.garch_forecasts(df, SMALL, forecasts.refits(df, SMALL, vol.SPECS[3:4]), fhs="GJR-GARCH(1,1)-normal")
    cut = days(340)[320]
    key = ["model", "date"]
    a = rolled[1].filter((F.col("date") <= F.lit(cut)) & (F.col("model") != "GJR-GARCH(1,1)-t")).select(*key, "sigma", "var_99", "es_97_5").toPandas().sort_values(key)
    b = again.filter(F.col("date") <= F.lit(cut)).select(*key, "sigma", "var_99", "es_97_5").toPandas().sort_values(key)
    assert len(a) == 2 * 21
    np.testing.assert_allclose(a[["sigma", "var_99", "es_97_5"]], b[["sigma", "var_99", "es_97_5"]], rtol=1e-9)


def test_short_history_is_refused(spark, series):
    with pytest.raises(ValueError, match="the window needs 300"):
        forecasts.check_history(frame(spark, series), "2020-03-01", "2020-12-01", 300)
    with pytest.raises(ValueError, match="No forecast dates"):
        forecasts.check_history(frame(spark, series), "2030-03-01", "2030-12-01", 300)


def test_in_sample_fits(spark, series):
    f = forecasts.fits(frame(spark, series)).cache()
    stats = {r["model"]: r for r in forecasts.fit_statistics(f).collect()}
    assert len(stats) == 6
    row = stats["GJR-GARCH(1,1)-t"]
    assert row["n_params"] == 6 and row["aic"] == pytest.approx(12 - 2 * row["loglik"])
    assert row["half_life"] == pytest.approx(math.log(0.5) / math.log(row["persistence"]))
    lr = {(r["restricted"], r["full"]): r for r in forecasts.likelihood_ratios(f).collect()}
    assert len(lr) == 5 and all(r["lr"] >= 0 and 0 <= r["p_value"] <= 1 for r in lr.values())
    table = forecasts.parameter_table(f, ["GARCH(1,1)-normal", "GJR-GARCH(1,1)-t"]).collect()
    assert {r["param"]: r["GARCH(1,1)-normal"] for r in table}["nu"] == "-"
    assert forecasts.best(forecasts.fit_statistics(f)).count() == 1
    assert forecasts.residuals(f).count() == 6 * 340


# --- backtests ---


def hit_frame(spark, pattern):
    return spark.createDataFrame([("A", "m", 0.99, d, c == "1") for d, c in zip(days(len(pattern)), pattern)], "symbol string, model string, level double, date date, hit boolean")


def test_transitions_by_hand(spark):
    r = one(backtests.coverage(hit_frame(spark, "0011000100"), (0.99,)))
    assert (r["n00"], r["n01"], r["n10"], r["n11"]) == (4, 2, 2, 1)
    a, x, n = 1 - 0.99, 3, 10
    lr = 2 * (x * math.log(0.3) + 7 * math.log(0.7) - x * math.log(a) - 7 * math.log(1 - a))
    assert r["lr_uc"] == pytest.approx(lr) and r["p_uc"] == pytest.approx(special.chi2_sf(lr, 1), abs=1e-12)


def test_no_exceptions_and_clusters(spark):
    none = one(backtests.coverage(hit_frame(spark, "0" * 500), (0.99,)))
    assert none["exceptions"] == 0 and none["pi11"] == 0.0 and none["lr_ind"] == 0.0
    clustered = "".join("11111" + "0" * 495 for _ in range(10))
    assert one(backtests.coverage(hit_frame(spark, clustered), (0.99,)))["p_ind"] < 1e-6


def test_traffic_light_needs_full_windows(spark):
    z = one(backtests.traffic_light(hit_frame(spark, "0" * 260 + "11111" + "0" * 35)))
    assert z["max_exceptions"] == 5 and z["green"] + z["yellow"] + z["red"] == pytest.approx(1)
    assert z["yellow"] == pytest.approx(36 / 51)
    assert backtests.traffic_light(hit_frame(spark, "0" * 249)).count() == 0


def forecast_rows(spark, y, var, es, model="m"):
    return spark.createDataFrame([("A", model, d, float(r), 1.0, var, var, es) for d, r in zip(days(len(y)), y)], "symbol string, model string, date date, ret double, sigma double, var_99 double, var_97_5 double, es_97_5 double")


def test_es_tests_tell_good_from_bad(spark):
    y = np.random.default_rng(0).normal(size=4000)
    q, e = special.norm_ppf(0.025), special.norm_pdf(special.norm_ppf(0.025)) / 0.025
    good, bad = (one(backtests.es_table(forecast_rows(spark, y, -q, x), (0.975,), reps=499)) for x in (e, e * 0.65))
    assert good["p_z2"] > 0.05 and good["p_residual"] > 0.05
    assert bad["p_z2"] < 0.05 and bad["p_residual"] < 0.01 and bad["z2"] < good["z2"]
    calm = one(backtests.es_table(forecast_rows(spark, y[:100] * 0.01, 2.0, 2.3), (0.975,), reps=99))
    assert calm["mean_residual"] is None and calm["p_residual"] is None
    v = backtests.verdicts(backtests.coverage(backtests.hits(forecast_rows(spark, y, -q, e), (0.975,)), (0.975,)), backtests.es_table(forecast_rows(spark, y[:100] * 0.01, 2.0, 2.3), (0.975,), reps=99))
    assert {r["test"]: r["verdict"] for r in v.collect()}["McNeil-Frey"] == "REJECT"


# --- losses ---


def test_loss_values(spark):
    row = spark.createDataFrame([(-3.0, 1.0)], "a double, b double").select(
        columns.tick_loss(F.col("a"), F.lit(2.0), 0.025).alias("t1"), columns.tick_loss(F.col("b"), F.lit(2.0), 0.025).alias("t2"), columns.fz0_loss(F.col("a"), F.lit(2.0), F.lit(2.5), 0.025).alias("fz"), columns.qlike(F.lit(2.0), F.lit(3.0)).alias("q")
    ).first()
    assert (row["t1"], row["t2"]) == pytest.approx((0.975, 0.075))
    assert row["fz"] == pytest.approx(1 / (0.025 * 2.5) + 2 / 2.5 + math.log(2.5) - 1)
    assert row["q"] == pytest.approx(math.log(2) + 1.5)
    for expr in (columns.fz0_loss(F.lit(1.0), F.lit(2.0), F.lit(0.0), 0.025), columns.qlike(F.lit(0.0), F.lit(1.0))):
        with pytest.raises(Exception, match="must be positive"):
            spark.range(1).select(expr.alias("x")).collect()


def test_losses_are_least_at_the_truth(spark):
    y = np.random.default_rng(1).normal(size=50_000)
    q, e = -special.norm_ppf(0.025), special.norm_pdf(special.norm_ppf(0.025)) / 0.025
    parts = [forecast_rows(spark, y, q * k, e * j, f"{k}-{j}") for k, j in ((1.0, 1.0), (0.8, 1.0), (1.25, 1.0), (1.0, 1.25))]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    ranks = {(r["loss"][:6], r["model"]): r["rank"] for r in losses.ranked(losses.risk_losses(all_, (0.975,), (0.975,)), "1.0-1.0").collect()}
    assert ranks["VaR an", "1.0-1.0"] == 1
    assert ranks["VaR 97", "1.0-1.0"] == ranks["VaR 97", "1.0-1.25"] == 1  # ties share a truncated rank


def loss_frame(spark, matrix, names):
    rows = [("A", "L", m, d, float(v)) for d, r in zip(days(len(matrix)), matrix) for m, v in zip(names, r)]
    return spark.createDataFrame(rows, "symbol string, loss string, model string, date date, value double")


def test_diebold_mariano_equals_numpy(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=402)
    d = noise[2:] + 0.6 * noise[1:-1] + 0.3 * noise[:-2] + 0.2
    r = one(losses.diebold_mariano(loss_frame(spark, np.column_stack([d, np.zeros(400)]), ["a", "b"]), "b"))
    lags = losses.newey_west_lags(400)
    u = d - d.mean()
    v = u @ u + sum(2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k]) for k in range(1, lags + 1))
    assert losses.newey_west_lags(4027) == 9 and r["lags"] == lags
    assert r["t_stat"] == pytest.approx(d.mean() / math.sqrt(v / 400 / 400))
    assert one(losses.diebold_mariano(loss_frame(spark, np.ones((50, 2)), ["a", "b"]), "b"))["t_stat"] is None


def test_comparison_and_shared_variances(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 1)) + rng.normal(0, 0.3, (300, 3)) + np.array([0, 0.02, 0.5])
    c = losses.comparison(loss_frame(spark, m, ["a", "b", "c"]), "a", reps=300)
    rows = {r["model"]: r for r in c.collect()}
    assert rows["c"]["rank"] == 3 and not rows["c"]["in_mcs"] and rows["a"]["t_stat"] is None
    wide = losses.rank_matrix(c, ["L", "other"]).collect()
    assert {r["model"]: (r["L"], r["other"]) for r in wide}["c"] == ("3", "-")
    assert {r["verdict"] for r in losses.decision(c, "a").collect()} == {"not supported"}
    f = forecast_rows(spark, m[:20, 0], 2.0, 2.3, "own").unionByName(forecast_rows(spark, m[:20, 0], 1.0, 2.3, "same")).unionByName(forecast_rows(spark, m[:20, 0], 1.0, 2.3, "none").withColumn("sigma", F.lit(float("nan"))))
    assert [r["model"] for r in losses.variance_models(f).collect()] == ["own"]
    pair = losses.paired(c.select("symbol", "loss", "model", "rank"), c.select("symbol", "loss", "model", "rank").filter("model = 'a'"), "rank")
    assert {r["rank"] for r in pair.collect()} == {"1 -> 1", "2 -> -", "3 -> -"}


# --- macro ---


def test_real_time_growth_by_hand(spark):
    rows = [("v", *(dt.date.fromisoformat(x) if x else None for x in r[:3]), r[3]) for r in (
        ("2019-10-01", "2019-11-15", "2019-12-16", 100.0), ("2019-10-01", "2019-12-17", None, 101.0), ("2019-11-01", "2019-12-17", "2020-01-15", 102.0),
        ("2019-11-01", "2020-01-16", None, 103.0), ("2019-12-01", "2020-01-16", None, 104.0),
    )]
    df = spark.createDataFrame(rows, "variable string, date date, realtime_start date, realtime_end date, value double")
    got = {r["reference_month"].month: r for r in macro.real_time_growth(df).collect()}
    assert set(got) == {11, 12}
    assert got[11]["value"] == pytest.approx(100 * math.log(102 / 101)) and got[12]["value"] == pytest.approx(100 * math.log(104 / 103))
    assert got[11]["release_date"] == dt.date(2019, 12, 17)


def test_monthly_mean_needs_days(spark):
    rows = [("v", d, float(d.month)) for d in days(31 + 9)] + [("v", dt.date(2020, 3, 1), float("nan"))]
    got = macro.monthly_mean(spark.createDataFrame(rows, "variable string, date date, value double")).collect()
    assert [(r["reference_month"], r["value"], r["release_date"]) for r in got] == [(DAY, 1.0, dt.date(2020, 1, 31))]


def test_available_lags_equal_the_range_join(spark):
    rng = np.random.default_rng(4)
    months = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(40)]
    rows = [("v", m, float(i), m + dt.timedelta(days=int(rng.integers(1, 150)))) for i, m in enumerate(months)]
    monthly = spark.createDataFrame(rows, "variable string, reference_month date, value double, release_date date")
    got = {r["month"]: r for r in macro.available_lags(monthly, spark.createDataFrame([(m,) for m in months], "month date"), 4).collect()}
    assert len(got) == 40
    for m in months:
        known = sorted([(r[1], r[2]) for r in rows if r[3] < m], reverse=True)
        assert got[m]["latest_reference_month"] == (known[0][0] if known else None)
        assert got[m]["lags"] == ([v for _, v in known[:4]] if len(known) >= 4 else None)


def test_daily_lags_must_be_complete(spark, series):
    lags = spark.createDataFrame([("v", DAY, [1.0, 2.0])], "variable string, month date, lags array<double>")
    with pytest.raises(ValueError, match="No complete macro lags"):
        macro.daily_lags(frame(spark, series), lags)
    x = macro.weighted(macro.daily_lags(frame(spark, series[:20]), lags), 1.0, 2).first()["x"]
    assert x == pytest.approx(1.5)


def test_midas_forecasts_do_not_look_ahead(spark):
    y = vol.simulate(170, vol.Spec(True, "normal"), {"mu": 0.0, "omega": 0.05, "alpha": 0.05, "gamma": 0.1, "beta": 0.85}, 8)
    s = ForecastSettings(window=150, refit_every=10, historical_window=100)
    rng = np.random.default_rng(5)
    lags = {m: rng.normal(size=3).tolist() for m in range(1, 13)}

    def run(values):
        rows = [("A", "v", d, float(r), lags[d.month]) for d, r in zip(days(170), values)]
        return forecasts.midas_forecasts(spark.createDataFrame(rows, "symbol string, variable string, date date, ret double, lags array<double>"), s, 3, dist="normal")

    f, p = run(y)
    changed = np.array(y)
    changed[160:] *= 10
    a, b = by_date(f), by_date(run(changed)[0])
    assert len(a) == 20 and p.count() == 2
    for d in days(170)[150:161]:
        assert a[d]["var_99"] == pytest.approx(b[d]["var_99"], rel=1e-9)
    assert one(forecasts.theta_summary(p))["refits"] == 2
