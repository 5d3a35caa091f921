import copy
import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest

from varloom.plans import config, periods, reporting
from varloom.plans.pipelines import Project
from varloom.sources import calendar, http, snapshots
from varloom.streaming import bars, ewma

CFG = {
    "data": {"ticker": "ABC", "start": "2020-01-01", "end": "2021-12-31", "raw_snapshot": "abc.parquet"},
    "sample_split": {"estimation_window": 260, "development": ["2021-01-04", "2021-06-30"], "locked_test": ["2021-07-01", "2021-09-30"]},
    "risk": {"confidence_levels_var": [0.99, 0.975], "confidence_levels_es": [0.975], "horizon_days": 1},
    "returns": {"scale": 100},
    "evaluation": {"volatility_proxy": "gk_overnight", "robustness_proxies": ["sq_ret"]},
    "forecasting": {"refit_every": 200, "historical_window": 250, "ewma_lambda": 0.94},
    "comparison": {"benchmark": "GJR-GARCH(1,1)-skewt", "mcs_confidence": 0.9, "block_length": 10, "bootstrap_reps": 200},
    "macro": {"start": "2018-01-01", "midas_lags": 3, "variables": {"spread": ["X", "monthly_mean"]}, "snapshot": "macro"},
}


def broken(path, value):
    cfg = copy.deepcopy(CFG)
    at = cfg
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return cfg


def test_valid_config_passes(tmp_path):
    config.validate(CFG)
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps(CFG))
    assert config.ForecastSettings.of(config.load(path)).window == 260
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.yaml")


@pytest.mark.parametrize(
    "path,value,message",
    [
        (("data", "ticker"), "", "ticker"), (("data", "raw_snapshot"), "x.csv", "raw_snapshot"), (("data", "start"), "2030-01-01", "development.0: 2021-01-04 comes too early"), (("data", "end"), "soon", "data.end: 'soon' is not a day"), (("data", "start"), None, "data.start: None is not a day"),
        (("sample_split", "estimation_window"), True, "estimation_window"), (("sample_split", "development"), ["2021-01-04"], "first and last day"), (("sample_split", "development"), ["2021-01-04", "2021-08-30"], "locked_test.0: 2021-07-01 comes too early"),
        (("sample_split", "development"), ["2021-01-04", "2021-01-04"], "development.1"), (("sample_split", "locked_test"), ["2021-07-01", "2029-01-01"], "data.end: 2021-12-31 comes too early"), (("risk", "confidence_levels_var"), [0.01], "tail probability"),
        (("risk", "confidence_levels_es"), [1.5], "confidence_levels_es"), (("risk", "confidence_levels_es"), [], "one or more levels"), (("returns", "scale"), float("nan"), "scale"), (("risk", "horizon_days"), 0, "horizon_days"),
    ],
)
def test_config_problems_are_named(path, value, message):
    with pytest.raises(ValueError, match=message):
        config.validate(broken(path, value))


def test_all_config_problems_come_together():
    cfg = broken(("returns", "scale"), -1)
    cfg["risk"]["horizon_days"] = 0
    with pytest.raises(config.ConfigError) as err:
        config.validate(cfg)
    assert len(err.value.problems) == 2
    with pytest.raises(ValueError, match="risk: no such section"):
        config.validate({"data": {}})
    with pytest.raises(ValueError, match="data: no such section"):
        config.validate(None)


def test_settings_are_checked():
    with pytest.raises(ValueError, match="historical_window: 250 days are more"):
        config.ForecastSettings(window=100)
    with pytest.raises(ValueError, match="ewma_lambda"):
        config.ForecastSettings(ewma_lambda=1.0)
    with pytest.raises(ValueError, match="bootstrap_reps"):
        config.ComparisonSettings("m", bootstrap_reps=10)
    with pytest.raises(ValueError, match="one of"):
        config.MacroSettings("2000-01-01", "2001-01-01", 3, {"a": ("X", "median")})
    with pytest.raises(ValueError, match="macro.start: not given"):
        config.MacroSettings.of({k: v for k, v in CFG.items() if k != "macro"})


def test_guard_refuses_a_second_locked_run(spark, tmp_path):
    out = [f"file://{tmp_path}/out"]
    periods.guard(spark, "locked_test", out)
    (tmp_path / "out").mkdir()
    with pytest.raises(FileExistsError, match="evaluated already"):
        periods.guard(spark, "locked_test", out)
    periods.guard(spark, "locked_test", out, allow_rerun=True)
    periods.guard(spark, "development", out)
    with pytest.raises(ValueError, match="other"):
        periods.checked("other")


def test_numbers_and_tables(spark):
    assert [reporting.number(v) for v in (True, 12345, 0.0, 1e-6, 1.23456, 1234.56, math.nan, None, "x")] == ["True", "12,345", "0", "1.0e-06", "1.2346", "1,234.6", "n/a", "n/a", "x"]
    df = spark.createDataFrame([("a", 1.5, 3)], "model string, v double, n int")
    assert reporting.markdown(df, "model") == "|  | v | n |\n|---|---|---|\n| a | 1.5000 | 3 |"


def test_exchange_calendar(spark):
    days = {r["date"] for r in calendar.exchange_days(spark, "2020-01-01", "2020-12-31").collect()}
    assert len(days) == 253
    closed = ["2020-01-01", "2020-01-20", "2020-02-17", "2020-04-10", "2020-05-25", "2020-07-03", "2020-09-07", "2020-11-26", "2020-12-25"]
    assert not days & {dt.date.fromisoformat(d) for d in closed}
    assert calendar.exchange_days(spark, "2021-01-01", "2021-12-31").count() == 252
    assert calendar.exchange_days(spark, "2022-01-01", "2022-12-31").count() == 251
    assert calendar.easter(2024) == dt.date(2024, 3, 31)


# --- connectors, with replaced getters ---


def records(first="2020-01-02", n=20):
    start = dt.date.fromisoformat(first)
    return [{"date": f"{start + dt.timedelta(days=i)}T00:00:00.000Z", "close": 10 + i, "high": 11.0 + i, "low": 9.0, "open": 10.0, "volume": 5, "adjClose": 10.0 + i, "divCash": 0.0, "splitFactor": 1} for i in range(n)][::-1]


def test_price_download_writes_once(spark, tmp_path):
    folder, asked = f"file://{tmp_path}", []

    def get(url):
        asked.append(url)
        return json.dumps(records())

    args = (spark, "BRK-B", "2020-01-01", "2020-01-25", folder, get)
    path = snapshots.download_prices(*args, today=dt.date(2026, 1, 2))
    assert path.endswith("brkb_2020-01-01_2020-01-25_dl20260102.parquet") and "startDate=2020-01-01" in asked[0]
    rows = spark.read.parquet(path).orderBy("date").collect()
    assert rows[0]["date"] == dt.date(2020, 1, 2) and rows[-1]["adj_close"] == 29.0 and rows[0]["symbol"] == "BRK-B"
    meta = json.loads((tmp_path / "brkb_2020-01-01_2020-01-25_dl20260102.json").read_text())
    assert meta["n_rows"] == 20 and meta["last_date"] == "2020-01-21"
    with pytest.raises(FileExistsError):
        snapshots.download_prices(*args, today=dt.date(2026, 1, 2))
    snapshots.download_prices(*args, today=dt.date(2026, 1, 2), overwrite=True)


@pytest.mark.parametrize("start,end,message", [("2020-01-01", "2020-01-10", "after the end"), ("2019-12-01", "2020-01-25", "after the start"), ("2020-01-01", "2020-03-01", "before the end")])
def test_partial_downloads_are_rejected(spark, tmp_path, start, end, message):
    with pytest.raises(RuntimeError, match=message):
        snapshots.download_prices(spark, "A", start, end, f"file://{tmp_path}", lambda url: json.dumps(records()))
    assert list(tmp_path.iterdir()) == []


def test_keys_come_from_the_environment(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("TIINGO_API_KEY", raising=False)
    with pytest.raises(RuntimeError, match="TIINGO_API_KEY"):
        snapshots.download_prices(spark, "A", "2020-01-01", "2020-02-01", f"file://{tmp_path}")


def macro_get(pages, fail=0):
    state = {"calls": 0}

    def get(url):
        state["calls"] += 1
        if state["calls"] <= fail:
            raise http.Temporary("busy")
        offset = int(url.rpartition("offset=")[2])
        total = [r for p in pages for r in p]
        size = len(pages[0])
        return json.dumps({"count": len(total), "observations": total[offset : offset + size]})

    return get, state


def observation(d, v, start="2020-01-01", end="9999-12-31"):
    return {"date": d, "value": v, "realtime_start": start, "realtime_end": end}


def test_macro_pages_and_marks(spark):
    get, state = macro_get([[observation("2020-01-02", "."), observation("2020-01-01", "1.5")], [observation("2020-01-03", "2", end="2020-05-01")]])
    pages = list(http.observation_pages("S", "secret", "2020-01-01", "2020-02-01", True, get))
    assert state["calls"] == 2
    rows = snapshots.observations(spark, pages, "v", True).collect()
    assert [r["value"] for r in rows] == [1.5, None, 2.0]
    assert [r["realtime_end"] for r in rows] == [None, None, dt.date(2020, 5, 1)]
    with pytest.raises(RuntimeError, match="Unexpected response"):
        list(http.observation_pages("S", "k", "a", "b", False, lambda url: "{}"))


def test_retries():
    waits = []
    get, state = macro_get([[observation("2020-01-01", "1")]], fail=2)
    patient = http.retrying(get, sleep=waits.append)
    assert json.loads(patient("x?offset=0"))["count"] == 1 and waits == [5.0, 15.0]
    get, state = macro_get([[]], fail=9)
    with pytest.raises(RuntimeError, match="gave up after 4 attempts"):
        http.retrying(get, sleep=waits.append)("x?offset=0")

    def refused(url):
        raise RuntimeError("bad key")

    with pytest.raises(RuntimeError, match="bad key"):
        http.retrying(refused, sleep=waits.append)("x")


def test_macro_snapshot_is_all_or_nothing(spark, tmp_path):
    m = config.MacroSettings("2020-01-01", "2020-12-31", 3, {"a": ("A", "monthly_mean"), "b": ("B", "real_time_growth")})
    good, _ = macro_get([[observation("2020-01-01", "1")]])

    def second_fails(url):
        if "series_id=B" in url:
            raise RuntimeError("down")
        return good(url)

    with pytest.raises(RuntimeError, match="down"):
        snapshots.download_macro(spark, m, f"file://{tmp_path}", "secret", second_fails, dt.date(2026, 1, 2))
    assert list(tmp_path.iterdir()) == []
    path = snapshots.download_macro(spark, m, f"file://{tmp_path}", "secret", good, dt.date(2026, 1, 2))
    assert not any("secret" in p.read_text(errors="ignore") for p in tmp_path.rglob("*") if p.is_file())
    with pytest.raises(FileExistsError):
        snapshots.download_macro(spark, m, f"file://{tmp_path}", "secret", good, dt.date(2026, 1, 2))
    pinned = config.MacroSettings("2020-01-01", "2020-12-31", 3, m.variables, path.rpartition("/")[2])
    assert set(snapshots.load_macro(spark, pinned, f"file://{tmp_path}")) == {"a", "b"}
    with pytest.raises(ValueError, match="macro.snapshot"):
        snapshots.load_macro(spark, m, f"file://{tmp_path}")


# --- a whole project ---


def test_pipelines_end_to_end(spark, tmp_path):
    root = f"file://{tmp_path}"
    project = Project(spark, CFG, root)
    rng = np.random.default_rng(9)
    days = [r["date"] for r in calendar.exchange_days(spark, "2019-12-02", "2021-09-30").orderBy("date").collect()]
    open_ = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
    close = open_ * np.exp(rng.normal(0, 0.008, len(days)))
    df = pd.DataFrame({"symbol": "ABC", "date": days, "open": open_, "high": np.maximum(open_, close) * 1.004, "low": np.minimum(open_, close) * 0.996, "close": close, "volume": 5})
    for c in ("open", "high", "low", "close"):
        df[f"adj_{c}"] = df[c]
    spark.createDataFrame(df.assign(div_cash=0.0, split_factor=1.0)).write.parquet(f"{root}/raw/abc.parquet")
    assert project.check_data().filter("check <> 'large_move'").count() == 0
    assert project.build_returns().count() == len(days) - 1
    assert "## Ljung-Box" in project.stylized_facts()
    f = project.run_forecasts("locked_test")
    models = {r["model"] for r in f.select("model").distinct().collect()}
    assert len(models) == 9 and f.count() == 9 * len([d for d in days if d >= dt.date(2021, 7, 1)])
    with pytest.raises(FileExistsError):
        project.run_forecasts("locked_test")
    var, es, verdicts = project.backtests(f)
    assert var.count() == 18 and es.count() == 9 and verdicts.count() == 9 * 8
    compared = project.compare(f)
    losses = {r["loss"] for r in compared.select("loss").distinct().collect()}
    assert losses == {"VaR 99.0%, tick loss", "VaR 97.5%, tick loss", "VaR and ES 97.5%, FZ0 loss", "variance, QLIKE vs gk_overnight", "variance, QLIKE vs sq_ret", "variance, MSE vs gk_overnight"}
    assert "## Refits" in project.forecast_report("locked_test")
    project.fit_garch()
    assert {"## Nested models", "## Residuals: Ljung-Box", "## Chosen"} <= set(project.fit_report().splitlines())
    assert "## Traffic light" in project.backtest_report("locked_test") and " *" in project.comparison_report("locked_test")
    f.write.partitionBy("model").parquet(project.path("forecasts", "development"))
    rejected, lost = project.rejections_and_losses(("forecasts",))
    assert rejected.count() == 9 and all(a == b for r in lost.collect() for a, b in [r["mean_loss"].split(" -> ")])


# --- streams ---


def test_stream_of_variances_carries_state(spark, tmp_path):
    schema = "symbol string, date timestamp, ret double"
    rows = [("A", dt.datetime(2020, 1, i), float(i)) for i in range(1, 7)]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    (tmp_path / "all").mkdir()
    q = None
    for i in (0, 1):
        for f in (tmp_path / f"in{i}").glob("part*"):
            f.rename(tmp_path / "all" / f"{i}-{f.name}")
        stream = ewma.ewma(spark.readStream.schema(schema).parquet(f"{tmp_path}/all"), start=1.0)
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    got = [r["sigma2"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("date").collect()]
    v, expected = 1.0, []
    for _, _, r in rows:
        expected.append(v)
        v = 0.94 * v + 0.06 * r * r
    assert got == pytest.approx(expected)


def test_stream_of_bars_equals_the_batch(spark):
    from varloom.sources import views

    path = "/root/testdata/sf0.001"
    a = bars.run_once(spark, f"{path}/events.parquet").orderBy("date").collect()
    b = views.bars_hourly(spark, path).drop("symbol").orderBy("date").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
