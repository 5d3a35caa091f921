"""The entry points: each a composition of operators, with its outputs written once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.columns import level_name
from varloom.operators import backtests, forecasts, losses, macro, quality, returns, stylized
from varloom.plans import config, periods, reporting
from varloom.sources import calendar, snapshots


@dataclass(frozen=True)
class Project:
    """A configuration and the folders of its data; every step reads what earlier ones wrote."""

    spark: SparkSession
    cfg: dict
    root: str

    def path(self, name: str, period: str | None = None) -> str:
        suffix = f"_{periods.checked(period)}" if period else ""
        return f"{self.root.rstrip('/')}/{name}{suffix}"

    def read(self, name: str, period: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.path(name, period))

    @property
    def settings(self) -> config.ForecastSettings:
        return config.ForecastSettings.of(self.cfg)

    def check_data(self) -> DataFrame:
        """Quality findings of the pinned snapshot against the exchange calendar, as CSV."""
        bars = snapshots.load_prices(self.spark, self.cfg, self.path("raw"))
        split = self.cfg["sample_split"]
        stylized.check_sample_fits(bars, split["development"], split["locked_test"], split["estimation_window"])
        first, last = bars.agg(F.min("date"), F.max("date")).first()
        found = quality.findings(bars, calendar=calendar.exchange_days(self.spark, str(first), str(last)))
        found.write.mode("overwrite").option("header", True).csv(self.path("quality_report.csv"))
        return found

    def build_returns(self) -> DataFrame:
        bars = snapshots.load_prices(self.spark, self.cfg, self.path("raw"))
        returns.check_common_factor(bars)
        returns.returns_and_proxies(bars, float(self.cfg["returns"]["scale"]), adjusted=True).write.mode("overwrite").parquet(self.path("returns.parquet"))
        return self.read("returns.parquet")

    def stylized_facts(self) -> str:
        """Only days before the locked test."""
        r = periods.returns_for(self.read("returns.parquet"), self.cfg, "development")
        proxy = self.cfg.get("evaluation", {}).get("volatility_proxy", "gk_overnight")
        return reporting.report(
            "Stylized facts",
            periods.NOTES["development"],
            [
                ("Distribution", stylized.distribution_summary(r), "symbol"), ("Tails", stylized.tail_counts(r), "symbol"), ("Autocorrelation", stylized.autocorrelations(r), "symbol"),
                ("Robust autocorrelation", stylized.robust_autocorrelation(r), "symbol"), ("Ljung-Box", stylized.ljung_box(r), "symbol"), ("ARCH-LM", stylized.arch_lm(r), "symbol"),
                ("Leverage", stylized.leverage(r, proxy=proxy), "symbol"), ("Proxies", returns.proxy_summary(r), "symbol"),
            ],
        )

    def fit_garch(self) -> DataFrame:
        r = periods.returns_for(self.read("returns.parquet"), self.cfg, "development")
        forecasts.fits(r).write.mode("overwrite").parquet(self.path("garch_fits.parquet"))
        return self.read("garch_fits.parquet")

    def macro_monthly(self) -> DataFrame:
        m = config.MacroSettings.of(self.cfg)
        raw = snapshots.load_macro(self.spark, m, self.path("raw"))
        return macro.build(raw, {n: t for n, (_, t) in m.variables.items()})

    def run_forecasts(self, period: str, allow_rerun: bool = False) -> DataFrame:
        """All rolling models: historical simulation, EWMA, six GARCH models and filtered historical simulation."""
        out = {n: self.path(n, period) for n in ("forecasts", "params")}
        periods.guard(self.spark, period, list(out.values()), allow_rerun)
        s, (start, end) = self.settings, periods.bounds(self.cfg, period)
        r = periods.returns_for(self.read("returns.parquet"), self.cfg, period).select("symbol", "date", "ret")
        forecasts.check_history(r, start, end, s.window)
        forecasts.refits(r, s, start=start, end=end).write.mode("overwrite").parquet(out["params"])
        rolled = forecasts.garch_forecasts(r, s, self.spark.read.parquet(out["params"]), start, end, fhs="GJR-GARCH(1,1)-normal")
        both = forecasts.historical_simulation(r, s, start, end).unionByName(forecasts.ewma(r, s, start, end)).unionByName(rolled)
        both.write.mode("overwrite").partitionBy("model").parquet(out["forecasts"])
        return self.read("forecasts", period)

    def run_macro_forecasts(self, period: str, allow_rerun: bool = False) -> DataFrame:
        """The expanding baseline and one MIDAS model for each macro variable."""
        out = {n: self.path(n, period) for n in ("macro_forecasts", "macro_params")}
        periods.guard(self.spark, period, list(out.values()), allow_rerun)
        s, m, (start, end) = self.settings, config.MacroSettings.of(self.cfg), periods.bounds(self.cfg, period)
        r = periods.returns_for(self.read("returns.parquet"), self.cfg, period).select("symbol", "date", "ret")
        lags = macro.available_lags(self.macro_monthly(), r.select(F.trunc("date", "MM").alias("month")).distinct(), m.midas_lags)
        made, params = forecasts.midas_forecasts(macro.daily_lags(r, lags), s, m.midas_lags, start=start, end=end)
        skew = [x for x in forecasts.vol.SPECS if x.name == "GJR-GARCH(1,1)-skewt"]
        base = forecasts.garch_forecasts(r, s, forecasts.refits(r, s, skew, start, end, expanding=True), start, end, expanding=True)
        base.unionByName(made).write.mode("overwrite").partitionBy("model").parquet(out["macro_forecasts"])
        params.write.mode("overwrite").parquet(out["macro_params"])
        return self.read("macro_forecasts", period)

    def backtests(self, forecast: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(VaR table, ES table, verdicts)."""
        s = self.settings
        var, es = backtests.var_table(forecast, s.var_levels), backtests.es_table(forecast, s.es_levels)
        return var, es, backtests.verdicts(var, es)

    def losses(self, forecast: DataFrame) -> DataFrame:
        s, e = self.settings, self.cfg.get("evaluation", {})
        risk = losses.risk_losses(forecast, s.var_levels, s.es_levels)
        return risk.unionByName(losses.variance_losses(forecast, self.read("returns.parquet"), e.get("volatility_proxy", "gk_overnight"), tuple(e.get("robustness_proxies", ()))))

    def compare(self, forecast: DataFrame) -> DataFrame:
        c = config.ComparisonSettings.of(self.cfg)
        return losses.comparison(self.losses(forecast), c.benchmark, confidence=c.mcs_confidence, block=c.block_length, reps=c.bootstrap_reps, seed=c.seed)

    def summarise(self, name: str = "macro_forecasts") -> DataFrame:
        """Both periods side by side: 'dev -> test' mean losses and verdicts of the decision rule."""
        benchmark = config.ComparisonSettings.of(self.cfg).benchmark
        dev, test = (losses.decision(self.compare(self.read(name, p)), benchmark) for p in periods.PERIODS)
        keys = ["symbol", "loss", "model"]
        cells = [losses.paired(dev.withColumn("mean_loss", F.round("mean_loss", 4)), test.withColumn("mean_loss", F.round("mean_loss", 4)), "mean_loss"), losses.paired(dev, test, "verdict")]
        return cells[0].join(cells[1], keys)

    def forecast_report(self, period: str) -> str:
        f, s = self.read("forecasts", period), self.settings
        return reporting.report(f"Forecasts: {periods.PERIODS[period]}", periods.NOTES[period], [("Models", forecasts.forecast_summary(f, s), "model"), ("Refits", forecasts.refit_summary(self.read("params", period)), "model")])

    def fit_report(self) -> str:
        """The fitted models side by side, what nested ones gain, and what their residuals still hold."""
        fitted = self.read("garch_fits.parquet")
        statistics, rest = forecasts.fit_statistics(fitted), forecasts.residuals(fitted)
        return reporting.report(
            "Volatility models",
            periods.NOTES["development"],
            [
                ("Models", statistics, "model"), ("Chosen", forecasts.best(statistics), "symbol"), ("Parameters", forecasts.parameter_table(fitted, [x.name for x in forecasts.vol.SPECS]), "param"),
                ("t-statistics", forecasts.t_statistics(fitted), "model"), ("Nested models", forecasts.likelihood_ratios(fitted), "restricted"), ("Residuals", stylized.distribution_summary(rest, "x"), "symbol"),
                ("Residuals: Ljung-Box", stylized.ljung_box(rest, "x"), "symbol"), ("Residuals: ARCH-LM", stylized.arch_lm(rest, "x"), "symbol"),
            ],
        )

    def macro_report(self, period: str) -> str:
        sections = [("Variables", macro.summary(self.macro_monthly()), "variable"), ("Theta", forecasts.theta_summary(self.read("macro_params", period)), "model"), ("Forecasts", forecasts.forecast_summary(self.read("macro_forecasts", period), self.settings), "model")]
        return reporting.report(f"Macro models: {periods.PERIODS[period]}", periods.NOTES[period], sections)

    def backtest_report(self, period: str, name: str = "forecasts") -> str:
        f = self.read(name, period)
        var, es, verdicts = self.backtests(f)
        lights = backtests.traffic_light(backtests.hits(f, self.settings.var_levels))
        sections = [("VaR", var, "model"), ("ES", es, "model"), ("Traffic light", lights, "model"), ("Verdicts", verdicts, "model"), ("Rejections", backtests.rejections(verdicts), "model")]
        return reporting.report(f"Backtests: {periods.PERIODS[period]}", periods.NOTES[period], sections)

    def comparison_report(self, period: str, name: str = "forecasts") -> str:
        compared = self.compare(self.read(name, period)).cache()
        try:
            names = sorted(r["loss"] for r in compared.select("loss").distinct().collect())
            benchmark = config.ComparisonSettings.of(self.cfg).benchmark
            sections = [("Ranks", losses.rank_matrix(compared, names), "model"), ("Losses", compared, "model"), ("Decision", losses.decision(compared, benchmark).select("symbol", "loss", "model", "verdict"), "model")]
            return reporting.report(f"Comparison: {periods.PERIODS[period]}", periods.NOTES[period], sections)
        finally:
            compared.unpersist()

    def rejections_and_losses(self, names: tuple[str, ...] = ("forecasts", "macro_forecasts")) -> tuple[DataFrame, DataFrame]:
        """Rejected tests by model and mean losses by model, 'development -> locked test', over several forecast tables."""
        rejected, lost = [], []
        for p in periods.PERIODS:
            made = [self.read(n, p) for n in names]
            counts = [backtests.rejections(self.backtests(f)[2]).withColumn("table", F.lit(n)) for n, f in zip(names, made, strict=True)]
            means = [losses.ranked(self.losses(f)).withColumn("table", F.lit(n)).withColumn("mean_loss", F.round("mean_loss", 4)) for n, f in zip(names, made, strict=True)]
            rejected.append(reduce(DataFrame.unionByName, counts))
            lost.append(reduce(DataFrame.unionByName, means))
        by_model = [r.select(F.concat_ws("|", "symbol", "table").alias("symbol"), F.lit("rejections").alias("loss"), "model", "rejections") for r in rejected]
        by_loss = [r.select(F.concat_ws("|", "symbol", "table").alias("symbol"), "loss", "model", "mean_loss") for r in lost]
        return losses.paired(*by_model, "rejections").drop("loss"), losses.paired(*by_loss, "mean_loss")

    def traffic_light_plot(self, period: str) -> DataFrame:
        """The counts behind the traffic-light figure."""
        return backtests.rolling_exceptions(backtests.hits(self.read("forecasts", period), self.settings.var_levels))

    def columns(self) -> list[str]:
        s = self.settings
        return [*(f"var_{level_name(v)}" for v in s.var_levels), *(f"es_{level_name(v)}" for v in s.es_levels)]
