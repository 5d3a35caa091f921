"""Registry of the reference operators' queries and their SQL oracles.

Every query runs over its whole tables.  Doubles are rounded to six decimals on
both sides, and levels enter as 1 - level computed in floating point.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from varloom.functions import sql
from varloom.functions import volatility as vol
from varloom.functions.shocks import quantile, tail_mean
from varloom.operators import backtests, forecasts, losses, macro, quality, returns, stylized
from varloom.plans.config import ForecastSettings
from varloom.sources import calendar, views
from varloom.sources.views import ctes

SETTINGS = ForecastSettings()
LEVELS = SETTINGS.var_levels
ES = SETTINGS.es_levels
LAMBDA = SETTINGS.ewma_lambda
A99, A975 = 1 - 0.99, 1 - 0.975
DEVELOPMENT, LOCKED = ("1997-01-01", "1998-12-31"), ("1999-01-01", "2001-12-31")
BENCHMARK = "EWMA-0.94"
#: Fixed parameters of the path queries.
GJR = {"mu": 0.05, "omega": 20.0, "alpha": 0.05, "gamma": 0.08, "beta": 0.85}
MIDAS = {"mu": 0.05, "alpha": 0.05, "gamma": 0.08, "beta": 0.85, "m0": 3.0, "theta": 0.4}
MIDAS_W, LAGS = 4.0, 12


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields))


def R(*names: str) -> str:  # noqa: N802
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) AS {n.split(' AS ')[-1]}" for n in names)


def ERFC(x: str) -> str:  # noqa: N802
    z = f"least({x}, 7.0)"
    return f"CASE WHEN {x} = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 151), lambda i_: exp((2 * i_ + 1) * ln({z}) - lgamma(i_ + 1.5) - {z} * {z})))) END"


def CHI(x: str, df: int) -> str:  # noqa: N802
    half = f"(greatest({x}, 0.0) / 2)"
    out = ERFC(f"sqrt{half}") if df % 2 else f"exp(-{half})"
    for k in range(1 if df % 2 else 2, df, 2):
        out = f"({out}) + pow({half}, {k / 2}) * exp(-{half}) / {math.gamma(k / 2 + 1)!r}"
    return f"least(1.0, {out})"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


# --- returns and quality ---

_BARS_RET = """b AS (SELECT *, lag(close) OVER (ORDER BY date) AS prev, row_number() OVER (ORDER BY date) AS n FROM bars),
p AS (SELECT date, 100 * ln(close / prev) AS ret, 100 * ln(open / prev) AS overnight_ret, pow(100 * ln(high / low), 2) / (4 * ln(2)) AS parkinson,
  0.5 * pow(100 * ln(high / low), 2) - (2 * ln(2) - 1) * pow(100 * ln(close / open), 2) AS garman_klass FROM b WHERE n > 1),
px2 AS (SELECT *, ret * ret AS sq_ret, overnight_ret * overnight_ret + garman_klass AS gk_overnight FROM p)"""


@query("returns_proxies", ctes("bars", more=_BARS_RET) + f" SELECT 'EVENTS' AS symbol, date, {R('ret', 'overnight_ret', 'sq_ret', 'parkinson', 'garman_klass', 'gk_overnight')} FROM px2")
def returns_proxies(spark, sf_dir):
    return rounded(returns.returns_and_proxies(views.bars_hourly(spark, sf_dir)))


@query(
    "proxy_summary",
    ctes("bars", more=_BARS_RET)
    + " SELECT 'EVENTS' AS symbol, count(*) AS n, "
    + ", ".join(f"round(sqrt(252 * avg({p})), 6) AS vol_{p}, round(avg({p}) / avg(sq_ret), 6) AS share_{p}" for p in returns.PROXIES)
    + " FROM px2",
)
def proxy_summary(spark, sf_dir):
    return rounded(returns.proxy_summary(returns.returns_and_proxies(views.bars_hourly(spark, sf_dir))))


_FINDINGS = f"""f AS (SELECT date, open, high, low, close, volume, lag(close) OVER (ORDER BY date) AS prev FROM bars),
g AS (
  SELECT date, 'missing_value' AS "check", 'error' AS severity, c || ' is missing' AS detail FROM (SELECT date, unnest(['open', 'high', 'low', 'close']) AS c, unnest([open, high, low, close]) AS v FROM f) WHERE v IS NULL
  UNION ALL SELECT date, 'non_positive_price', 'error', c || ' is zero or negative' FROM (SELECT date, unnest(['open', 'high', 'low', 'close']) AS c, unnest([open, high, low, close]) AS v FROM f) WHERE v <= 0
  UNION ALL SELECT date, 'ohlc_inconsistent', 'error', 'high is below low' FROM f WHERE high < low
  UNION ALL SELECT date, 'ohlc_inconsistent', 'error', 'high is below open or close' FROM f WHERE high < greatest(open, close)
  UNION ALL SELECT date, 'ohlc_inconsistent', 'error', 'low is above open or close' FROM f WHERE low > least(open, close)
  UNION ALL SELECT date, 'flat_bar', 'review', '{quality.FLAT}' FROM f WHERE open = high AND high = low AND low = close
  UNION ALL SELECT date, 'zero_volume', 'review', 'volume is zero' FROM f WHERE volume = 0
  UNION ALL SELECT date, 'large_move', 'review', format('daily log return of {{:+.2f}}%', 100 * ln(close / prev)) FROM f WHERE abs(ln(close / prev)) > 0.07)"""


@query("quality_findings", ctes("bars", more=_FINDINGS) + """ SELECT 'EVENTS' AS symbol, date, "check", severity, detail FROM g""")
def quality_findings(spark, sf_dir):
    return quality.findings(views.bars_hourly(spark, sf_dir))


@query("quality_summary", ctes("bars", more=_FINDINGS) + """ SELECT severity, "check", count(*) AS n FROM g GROUP BY ALL""")
def quality_summary(spark, sf_dir):
    return quality.summary(quality.findings(views.bars_hourly(spark, sf_dir)))


@query(
    "calendar_diff",
    """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), k AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY))::DATE AS date),
w AS (SELECT date FROM k WHERE isodow(date) < 6)
SELECT 'ALL' AS symbol, date, 'missing_trading_day' AS "check" FROM w WHERE date NOT IN (SELECT date FROM d)
UNION ALL SELECT 'ALL', date, 'not_a_trading_day' FROM d WHERE date NOT IN (SELECT date FROM w)""",
)
def calendar_diff(spark, sf_dir):
    days = views.table(spark, sf_dir, "orders").select(F.lit("ALL").alias("symbol"), F.to_date("o_orderdate").alias("date"))
    return quality.calendar_findings(days, calendar.weekdays(spark, "1995-01-01", "2001-08-01")).select("symbol", "date", "check")


@query(
    "sample_counts",
    ctes("px", "ret")
    + f" SELECT 'ALL' AS symbol, count(*) FILTER (date < DATE '{DEVELOPMENT[0]}') AS before_development, count(*) FILTER (date BETWEEN DATE '{DEVELOPMENT[0]}' AND DATE '{DEVELOPMENT[1]}') AS development, count(*) FILTER (date BETWEEN DATE '{LOCKED[0]}' AND DATE '{LOCKED[1]}') AS locked_test FROM ret",
)
def sample_counts(spark, sf_dir):
    return stylized.sample_counts(views.ret_daily(spark, sf_dir), DEVELOPMENT, LOCKED)


# --- stylized facts ---

_MOMENTS = "m AS (SELECT count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) AS mu FROM ret), s AS (SELECT avg(pow(ret - mu, 3)) / pow(avg(pow(ret - mu, 2)), 1.5) AS skew, avg(pow(ret - mu, 4)) / pow(avg(pow(ret - mu, 2)), 2) - 3 AS kurt FROM ret, m)"


@query(
    "dist_summary",
    ctes("px", "ret", more=_MOMENTS) + f", j AS (SELECT *, mean / (sd / sqrt(n)) AS t_mean, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jarque_bera FROM m, s) SELECT 'ALL' AS symbol, n, {R('mean', 'sd', 'skew', 'kurt', 't_mean', 'jarque_bera', 'exp(-jarque_bera / 2) AS jb_p')} FROM j",
)
def dist_summary(spark, sf_dir):
    return rounded(stylized.distribution_summary(views.ret_daily(spark, sf_dir)))


@query(
    "tail_counts",
    ctes("px", "ret", more="m AS (SELECT avg(ret) AS mu, stddev_samp(ret) AS sd, count(*) AS n FROM ret), k AS (SELECT unnest([3, 4, 5])::INTEGER AS k)")
    + f" SELECT 'ALL' AS symbol, k, (SELECT count(*) FROM ret WHERE abs((ret - mu) / sd) > k) AS observed, round(n * ({ERFC('(k / sqrt(2.0))')}), 6) AS expected FROM m, k",
)
def tail_counts(spark, sf_dir):
    return rounded(stylized.tail_counts(views.ret_daily(spark, sf_dir)))


@query(
    "autocorr",
    ctes("px", "ret") + " " + " UNION ALL ".join(f"SELECT 'ALL' AS symbol, {k}::INTEGER AS lag, round(corr(ret, z), 6) AS autocorr FROM (SELECT ret, lag(ret, {k}) OVER (ORDER BY date) AS z FROM ret)" for k in (1, 5, 10, 20)),
)
def autocorr(spark, sf_dir):
    return rounded(stylized.autocorrelations(views.ret_daily(spark, sf_dir)))


_LB = "u AS (SELECT date, ret - (SELECT avg(ret) FROM ret) AS u FROM ret), c AS (SELECT (SELECT count(*) FROM u) AS n, (SELECT sum(u * u) FROM u) AS s0), a AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, sum(u * z) AS s FROM (SELECT u, lag(u, {k}) OVER (ORDER BY date) AS z FROM u)" for k in range(1, 21)
) + "), t AS (SELECT lag, n * (n + 2) * sum(pow(s / s0, 2) / (n - k)) AS q FROM a, c, (SELECT unnest([5, 10, 20])::INTEGER AS lag) l WHERE k <= lag GROUP BY lag, n)"


@query(
    "ljung_box",
    ctes("px", "ret", more=_LB) + f" SELECT 'ALL' AS symbol, lag, round(q, 6) AS q, round(CASE lag WHEN 5 THEN {CHI('q', 5)} WHEN 10 THEN {CHI('q', 10)} ELSE {CHI('q', 20)} END, 6) AS p_value FROM t",
)
def ljung_box(spark, sf_dir):
    return rounded(stylized.ljung_box(views.ret_daily(spark, sf_dir)))


_RA = "z AS (" + " UNION ALL ".join(f"SELECT {k}::INTEGER AS lag, ret AS x, z FROM (SELECT ret, lag(ret, {k}) OVER (ORDER BY date) AS z FROM ret) WHERE z IS NOT NULL" for k in (1, 2, 5)) + """),
l AS (SELECT lag, regr_slope(x, z) AS b, regr_intercept(x, z) AS c, avg(z) AS zm, regr_sxx(x, z) AS sxx FROM z GROUP BY lag),
v AS (SELECT lag, b, sqrt(sum(pow(z - zm, 2) * pow(x - c - b * z, 2))) / sxx AS se FROM z JOIN l USING (lag) GROUP BY lag, b, sxx)"""


@query("robust_autocorr", ctes("px", "ret", more=_RA) + f" SELECT 'ALL' AS symbol, lag, {R('b AS autocorr', 'se AS robust_se', 'b / se AS t_stat')}, round({ERFC('(abs(b / se) / sqrt(2.0))')}, 6) AS p_value FROM v")
def robust_autocorr(spark, sf_dir):
    return rounded(stylized.robust_autocorrelation(views.ret_daily(spark, sf_dir)))


@query(
    "arch_lm_1",
    ctes("px", "ret", more="e AS (SELECT date, pow(ret - (SELECT avg(ret) FROM ret), 2) AS y FROM ret), z AS (SELECT y, lag(y) OVER (ORDER BY date) AS z FROM e), r AS (SELECT count(*) AS n, count(*) * regr_r2(y, z) AS lm FROM z WHERE z IS NOT NULL)")
    + f" SELECT 'ALL' AS symbol, n, round(lm, 6) AS lm, round({CHI('lm', 1)}, 6) AS p_value FROM r",
)
def arch_lm_1(spark, sf_dir):
    return rounded(stylized.arch_lm(views.ret_daily(spark, sf_dir), lags=1))


def _orthogonal(lags: int) -> str:
    """Gram-Schmidt over the centred lags: q{k} is lag k less its projections on the lags before it, y the square."""
    names = [f"z{k}" for k in range(1, lags + 1)]
    lagged = ", ".join(f"lag(y, {k}) OVER (ORDER BY date) AS z{k}" for k in range(1, lags + 1))
    out = [
        "e AS (SELECT date, pow(ret - (SELECT avg(ret) FROM ret), 2) AS y FROM ret)", f"l AS (SELECT y, {lagged} FROM e)",
        f"g0 AS (SELECT y - avg(y) OVER () AS y, {', '.join(f'{n} - avg({n}) OVER () AS {n}' for n in names)} FROM l WHERE {names[-1]} IS NOT NULL)",
    ]
    for k, n in enumerate(names, 1):
        rest = "".join(f", {m} - {n} * (sum({m} * {n}) OVER ()) / (sum({n} * {n}) OVER ()) AS {m}" for m in names[k:])
        out.append(f"g{k} AS (SELECT y{''.join(f', {m}' for m in names[:k])}{rest} FROM g{k - 1})")
    fit = " + ".join(f"pow(sum(y * {n}), 2) / sum({n} * {n})" for n in names)
    return ", ".join([*out, f"r AS (SELECT count(*) AS n, count(*) * ({fit}) / sum(y * y) AS lm FROM g{lags})"])


@query("arch_lm_5", ctes("px", "ret", more=_orthogonal(5)) + f" SELECT 'ALL' AS symbol, n, round(lm, 6) AS lm, round({CHI('lm', 5)}, 6) AS p_value FROM r")
def arch_lm_5(spark, sf_dir):
    return rounded(stylized.arch_lm(views.ret_daily(spark, sf_dir), lags=5))


_LEV = "w AS (SELECT ret AS r, lead(ret * ret) OVER (ORDER BY date) AS nx FROM ret), l AS (SELECT * FROM w, (VALUES ('all days', 0.0), ('above 1', 1.0)) t(moves, size) WHERE nx IS NOT NULL), a AS (SELECT moves, count(*) FILTER (r < -size) AS n_down, count(*) FILTER (r > size) AS n_up, avg(nx) FILTER (r < -size) AS after_down, avg(nx) FILTER (r > size) AS after_up FROM l GROUP BY moves)"


@query("leverage", ctes("px", "ret", more=_LEV) + f" SELECT 'ALL' AS symbol, moves, n_down, n_up, {R('after_down', 'after_up', 'after_down / after_up AS ratio')} FROM a")
def leverage(spark, sf_dir):
    return rounded(stylized.leverage(views.ret_daily(spark, sf_dir).withColumn("sq_ret", F.col("ret") * F.col("ret"))))


@query("next_day_corr", ctes("px", "ret") + " SELECT 'ALL' AS symbol, round(corr(r, nx), 6) AS corr FROM (SELECT ret AS r, lead(ret * ret) OVER (ORDER BY date) AS nx FROM ret)")
def next_day_corr(spark, sf_dir):
    return rounded(stylized.next_day_correlation(views.ret_daily(spark, sf_dir).withColumn("sq_ret", F.col("ret") * F.col("ret"))))


# --- forecasts ---

Q99, Q975 = quantile("normal", (), A99), quantile("normal", (), A975)
E975 = tail_mean("normal", (), A975)
_HS = f"""o AS (SELECT date, ret, row_number() OVER (ORDER BY date) AS n FROM ret),
hq AS (SELECT date, ret, n, quantile_cont(ret, {A99!r}) OVER w AS q99, quantile_cont(ret, {A975!r}) OVER w AS q975, list(ret) OVER w AS past FROM o WINDOW w AS (ORDER BY n ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
hs AS (SELECT date, ret, -q99 AS var_99, -q975 AS var_97_5, -list_avg(list_filter(past, lambda r: r <= q975)) AS es_97_5 FROM hq WHERE n > 250)"""
_EW = f"""bc AS (SELECT sum(ret * ret * pow(0.94, n - 1)) / sum(pow(0.94, n - 1)) AS b FROM o WHERE n <= 75),
ew AS (SELECT 1::BIGINT AS n, {1 - LAMBDA!r} * ret * ret + {LAMBDA!r} * b AS v FROM o, bc WHERE n = 1 UNION ALL SELECT o.n, {1 - LAMBDA!r} * ret * ret + {LAMBDA!r} * v FROM ew JOIN o ON o.n = ew.n + 1),
em AS (SELECT date, ret, sqrt(v) AS sigma FROM ew JOIN o ON o.n = ew.n + 1 WHERE o.n > 250)"""
_FC = f"""{_HS}, {_EW}, fc AS (SELECT 'HS-250' AS model, date, ret, NULL::DOUBLE AS sigma, var_99, var_97_5, es_97_5 FROM hs
  UNION ALL SELECT 'EWMA-0.94', date, ret, sigma, -sigma * {Q99!r}, -sigma * {Q975!r}, -sigma * {E975!r} FROM em)"""


def two_models(spark, sf_dir) -> DataFrame:
    """Historical simulation and EWMA forecasts of the daily series."""
    r = views.ret_daily(spark, sf_dir)
    return forecasts.historical_simulation(r, SETTINGS).unionByName(forecasts.ewma(r, SETTINGS))


@query("hs_var_es", ctes("px", "ret", more=_HS) + f" SELECT 'ALL' AS symbol, 'HS-250' AS model, date, {R('ret')}, NULL::DOUBLE AS sigma, {R('var_99', 'var_97_5', 'es_97_5')} FROM hs")
def hs_var_es(spark, sf_dir):
    return rounded(forecasts.historical_simulation(views.ret_daily(spark, sf_dir), SETTINGS))


@query("ewma_var_es", ctes("px", "ret", more=_FC) + f" SELECT 'ALL' AS symbol, model, date, {R('ret', 'sigma', 'var_99', 'var_97_5', 'es_97_5')} FROM fc WHERE model = 'EWMA-0.94'")
def ewma_var_es(spark, sf_dir):
    return rounded(forecasts.ewma(views.ret_daily(spark, sf_dir), SETTINGS))


@query(
    "panel_hs_var",
    ctes("panel", more=f"pr AS (SELECT symbol, date, 100 * ln(px / lag(px) OVER w) AS ret, row_number() OVER w - 1 AS n FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)), pq AS (SELECT symbol, date, ret, n, quantile_cont(ret, {A99!r}) OVER w AS q99, quantile_cont(ret, {A975!r}) OVER w AS q975, list(ret) OVER w AS past FROM pr WHERE n > 0 WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING))")
    + f" SELECT symbol, 'HS-250' AS model, date, {R('ret')}, NULL::DOUBLE AS sigma, {R('-q99 AS var_99', '-q975 AS var_97_5', '-list_avg(list_filter(past, lambda r: r <= q975)) AS es_97_5')} FROM pq WHERE n > 250",
)
def panel_hs_var(spark, sf_dir):
    out = forecasts.historical_simulation_grouped(views.returns_of(views.panel_daily(spark, sf_dir)), SETTINGS)
    return rounded(out.withColumn("sigma", F.lit(None).cast("double")))


_GJR = f"""o AS (SELECT ret, date, ret - {GJR['mu']} AS e, row_number() OVER (ORDER BY date) AS n FROM ret), mu AS (SELECT avg(ret) AS m FROM ret),
bc AS (SELECT sum(pow(ret - m, 2) * pow(0.94, n - 1)) / sum(pow(0.94, n - 1)) AS b FROM o, mu WHERE n <= 75),
gj AS (SELECT 1::BIGINT AS n, {GJR['omega']} + ({GJR['alpha']} + {GJR['gamma']} / 2) * b + {GJR['beta']} * b AS s FROM bc
  UNION ALL SELECT o.n + 1, {GJR['omega']} + ({GJR['alpha']} + {GJR['gamma']} * (e < 0)::INTEGER) * e * e + {GJR['beta']} * s FROM gj JOIN o ON o.n = gj.n),
gp AS (SELECT date, ret, s AS sigma2, e FROM gj JOIN o USING (n))"""


@query("garch_fixed_path", ctes("px", "ret", more=_GJR) + f" SELECT 'ALL' AS symbol, date, {R('ret', 'sigma2')} FROM gp")
def garch_fixed_path(spark, sf_dir):
    return rounded(forecasts.gjr_path(views.ret_daily(spark, sf_dir), **GJR))


@query("likelihood_normal_fixed", ctes("px", "ret", more=_GJR) + " SELECT 'ALL' AS symbol, count(*) AS n, round(sum(-0.5 * (ln(2 * pi()) + e * e / sigma2) - 0.5 * ln(sigma2)), 6) AS loglik FROM gp")
def likelihood_normal_fixed(spark, sf_dir):
    return rounded(forecasts.normal_likelihood(forecasts.gjr_path(views.ret_daily(spark, sf_dir), **GJR), GJR["mu"]))


_ROLL = f"""o AS (SELECT date, ret, ret - {GJR['mu']} AS e, row_number() OVER (ORDER BY date) AS n FROM ret),
d AS (SELECT n, date, ret, {GJR['omega']} + ((n - {SETTINGS.window + 1}) // {SETTINGS.refit_every}) % 3 AS omega FROM o WHERE n > {SETTINGS.window}),
wm AS (SELECT d.n, avg(o.ret) AS m FROM d JOIN o ON o.n >= d.n - {SETTINGS.window} AND o.n < d.n GROUP BY d.n),
wb AS (SELECT wm.n, sum(pow(ret - m, 2) * pow(0.94, o.n - wm.n + {SETTINGS.window})) / sum(pow(0.94, o.n - wm.n + {SETTINGS.window})) AS b FROM wm JOIN o ON o.n >= wm.n - {SETTINGS.window} AND o.n < wm.n - {SETTINGS.window} + 75 GROUP BY wm.n),
pa AS (SELECT d.n, 0::BIGINT AS t, omega, omega + ({GJR['alpha']} + {GJR['gamma']} / 2) * b + {GJR['beta']} * b AS s FROM d JOIN wb USING (n)
  UNION ALL SELECT pa.n, t + 1, omega, omega + ({GJR['alpha']} + {GJR['gamma']} * (e < 0)::INTEGER) * e * e + {GJR['beta']} * s FROM pa JOIN o ON o.n = pa.n - {SETTINGS.window} + t WHERE t < {SETTINGS.window}),
zs AS (SELECT pa.n, list(e / sqrt(s)) AS z, quantile_cont(e / sqrt(s), {A99!r}) AS q99, quantile_cont(e / sqrt(s), {A975!r}) AS q975 FROM pa JOIN o ON o.n = pa.n - {SETTINGS.window} + t WHERE t < {SETTINGS.window} GROUP BY pa.n),
rf AS (SELECT d.*, sqrt(s) AS sigma, q99, q975, list_avg(list_filter(z, lambda x: x <= q975)) AS e975 FROM d JOIN pa USING (n) JOIN zs USING (n) WHERE t = {SETTINGS.window}),
rw AS (SELECT 'GJR-GARCH(1,1)-normal' AS model, date, ret, sigma, {Q99!r} AS a, {Q975!r} AS b, {E975!r} AS c FROM rf UNION ALL SELECT 'FHS-GJR', date, ret, sigma, q99, q975, e975 FROM rf)"""


@query("garch_scheduled_rolling", ctes("px", "ret", more=_ROLL) + f" SELECT 'ALL' AS symbol, model, date, {R('ret', 'sigma')}, round(-({GJR['mu']} + sigma * a), 6) AS var_99, round(-({GJR['mu']} + sigma * b), 6) AS var_97_5, round(-({GJR['mu']} + sigma * c), 6) AS es_97_5 FROM rw")
def garch_scheduled_rolling(spark, sf_dir):
    """Rolling forecasts and filtered historical simulation under given parameters, whose omega changes at every refit."""
    omega = F.lit(GJR["omega"]) + F.col("refit") % 3
    cells = [x for n in ("mu", "alpha", "gamma", "beta") for x in (F.lit(n), F.lit(GJR[n]))]
    params = spark.range(1000).select(F.lit("ALL").alias("symbol"), F.lit("GJR-GARCH(1,1)-normal").alias("model"), F.col("id").cast("int").alias("refit")).withColumn("params", F.create_map(*cells, F.lit("omega"), omega))
    return rounded(forecasts.garch_forecasts(views.ret_daily(spark, sf_dir), SETTINGS, params, fhs="GJR-GARCH(1,1)-normal"))


_PERSISTENCE = GJR["alpha"] + GJR["gamma"] / 2 + GJR["beta"]
_STAT = f"ll AS (SELECT count(*) AS n, sum(-0.5 * (ln(2 * pi()) + e * e / sigma2) - 0.5 * ln(sigma2)) AS l FROM gp)"


@query(
    "fit_statistics_fixed",
    ctes("px", "ret", more=f"{_GJR}, {_STAT}")
    + f" SELECT 'ALL' AS symbol, 'GJR' AS model, round(l, 6) AS loglik, n, round(10 - 2 * l, 6) AS aic, round(5 * ln(n) - 2 * l, 6) AS bic, round({_PERSISTENCE!r}::DOUBLE, 6) AS persistence, round(ln(0.5) / ln({_PERSISTENCE!r}), 6) AS half_life, round({GJR["omega"]}::DOUBLE / (1 - {_PERSISTENCE!r}::DOUBLE), 6) AS unconditional_variance FROM ll",
)
def fit_statistics_fixed(spark, sf_dir):
    """Information criteria and persistence of a model with given parameters."""
    given = F.create_map(*(x for n, v in GJR.items() for x in (F.lit(n), F.lit(v))))
    likelihood = forecasts.normal_likelihood(forecasts.gjr_path(views.ret_daily(spark, sf_dir), **GJR), GJR["mu"])
    fitted = likelihood.select("symbol", F.lit("GJR").alias("model"), given.alias("params"), "loglik", F.col("n").alias("n_obs"), F.lit(True).alias("converged"))
    return rounded(forecasts.fit_statistics(fitted).drop("converged", "n_params").withColumnRenamed("n_obs", "n"))


# --- backtests ---

_HITS = "h AS (SELECT model, 0.99::DOUBLE AS level, date, -ret > var_99 AS hit FROM fc UNION ALL SELECT model, 0.975::DOUBLE, date, -ret > var_97_5 FROM fc)"
_XL = lambda x, y: f"(CASE WHEN {x} = 0 THEN 0.0 ELSE {x} * ln({y}) END)"
_COV = f"""t AS (SELECT *, lag(hit) OVER (PARTITION BY model, level ORDER BY date) AS prev FROM h),
c AS (SELECT model, level::DOUBLE AS level, (CASE WHEN level > 0.98 THEN {A99!r} ELSE {A975!r} END)::DOUBLE AS a, count(*) AS n, count(*) FILTER (hit) AS exceptions, count(*) FILTER (NOT prev AND NOT hit) AS n00, count(*) FILTER (NOT prev AND hit) AS n01, count(*) FILTER (prev AND NOT hit) AS n10, count(*) FILTER (prev AND hit) AS n11 FROM t GROUP BY ALL),
r AS (SELECT *, exceptions / n AS rate, CASE WHEN n00 + n01 = 0 THEN 0.0 ELSE n01 / (n00 + n01) END AS pi01, CASE WHEN n10 + n11 = 0 THEN 0.0 ELSE n11 / (n10 + n11) END AS pi11, (n01 + n11) / (n00 + n01 + n10 + n11) AS pi FROM c),
l AS (SELECT *, greatest(2 * ({_XL('exceptions', 'rate')} + {_XL('(n - exceptions)', '(1 - rate)')} - exceptions * ln(a) - (n - exceptions) * ln(1 - a)), 0.0) AS lr_uc,
  greatest(2 * ({_XL('n00', '(1 - pi01)')} + {_XL('n01', 'pi01')} + {_XL('n10', '(1 - pi11)')} + {_XL('n11', 'pi11')} - {_XL('(n00 + n10)', '(1 - pi)')} - {_XL('(n01 + n11)', 'pi')}), 0.0) AS lr_ind FROM r),
v AS (SELECT *, lr_uc + lr_ind AS lr_cc FROM l)"""
_RISK = f"{R('rate', 'n * a AS expected', 'lr_uc', 'pi01', 'pi11', 'lr_ind', 'lr_cc')}, round({CHI('lr_uc', 1)}, 6) AS p_uc, round({CHI('lr_ind', 1)}, 6) AS p_ind, round(exp(-lr_cc / 2), 6) AS p_cc"
_ZONES = """rx AS (SELECT model, level, date, sum(hit::INTEGER) OVER w AS exceptions, row_number() OVER (PARTITION BY model, level ORDER BY date) AS i FROM h WINDOW w AS (PARTITION BY model, level ORDER BY date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)),
z AS (SELECT model, level::DOUBLE AS level, avg((exceptions < 5)::INTEGER) AS green, avg((exceptions >= 5 AND exceptions < 10)::INTEGER) AS yellow, avg((exceptions >= 10)::INTEGER) AS red, max(exceptions)::BIGINT AS max_exceptions FROM rx WHERE i >= 250 GROUP BY ALL)"""


@query("hs_var_backtest", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_COV}, {_ZONES}") + f" SELECT 'ALL' AS symbol, v.model, v.level, n, exceptions, n00, n01, n10, n11, {_RISK}, {R('green', 'yellow', 'red')}, max_exceptions FROM v LEFT JOIN z ON z.model = v.model AND z.level = v.level AND v.level = 0.99 WHERE v.model = 'HS-250'")
def hs_var_backtest(spark, sf_dir):
    return rounded(backtests.var_table(forecasts.historical_simulation(views.ret_daily(spark, sf_dir), SETTINGS), LEVELS))


@query("var_backtests", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_COV}") + f" SELECT 'ALL' AS symbol, model, level, n, exceptions, n00, n01, n10, n11, {_RISK} FROM v")
def var_backtests(spark, sf_dir):
    return rounded(backtests.coverage(backtests.hits(two_models(spark, sf_dir), LEVELS), LEVELS))


@query("rolling_exceptions", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_ZONES}") + " SELECT 'ALL' AS symbol, model, level::DOUBLE AS level, date, exceptions::BIGINT AS exceptions FROM rx WHERE i >= 250")
def rolling_exceptions(spark, sf_dir):
    return backtests.rolling_exceptions(backtests.hits(two_models(spark, sf_dir), LEVELS))


@query("traffic_light", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_ZONES}") + f" SELECT 'ALL' AS symbol, model, level, {R('green', 'yellow', 'red')}, max_exceptions FROM z")
def traffic_light(spark, sf_dir):
    return rounded(backtests.traffic_light(backtests.hits(two_models(spark, sf_dir), LEVELS)))


_VERDICT = f"d AS (SELECT model, level, unnest(['Kupiec', 'independence', 'conditional coverage']) AS test, unnest([{CHI('lr_uc', 1)}, {CHI('lr_ind', 1)}, exp(-lr_cc / 2)]) AS p FROM v)"


@query("verdicts", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_COV}, {_VERDICT}") + " SELECT 'ALL' AS symbol, model, test, level, round(p, 6) AS p_value, CASE WHEN p >= 0.05 THEN 'pass' ELSE 'REJECT' END AS verdict FROM d")
def verdicts(spark, sf_dir):
    return rounded(backtests.verdicts(backtests.coverage(backtests.hits(two_models(spark, sf_dir), LEVELS), LEVELS)))


@query("rejections", ctes("px", "ret", more=f"{_FC}, {_HITS}, {_COV}, {_VERDICT}") + " SELECT 'ALL' AS symbol, model, count(*) AS tests, count(*) FILTER (p < 0.05) AS rejections FROM d GROUP BY model")
def rejections(spark, sf_dir):
    return backtests.rejections(backtests.verdicts(backtests.coverage(backtests.hits(two_models(spark, sf_dir), LEVELS), LEVELS)))


_EST = f"e AS (SELECT model, CASE WHEN -ret > var_97_5 THEN -ret / ({A975!r} * es_97_5) ELSE 0.0 END AS z, CASE WHEN -ret > var_97_5 THEN -ret / es_97_5 - 1 END AS r FROM fc)"


@query("es_stats", ctes("px", "ret", more=f"{_FC}, {_EST}") + " SELECT 'ALL' AS symbol, model, 0.975::DOUBLE AS level, round(1 - avg(z), 6) AS z2, count(r) AS n_exceptions, CASE WHEN count(r) >= 2 THEN round(avg(r), 6) END AS mean_residual FROM e GROUP BY model")
def es_stats(spark, sf_dir):
    return rounded(backtests.es_stats(two_models(spark, sf_dir), ES))


@query("es_bootstrap")
def es_bootstrap(spark, sf_dir):
    return rounded(backtests.es_table(two_models(spark, sf_dir), ES))


# --- losses ---

_TICK = lambda v, a: f"({a!r} - (CASE WHEN ret <= -{v} THEN 1 ELSE 0 END)) * (ret + {v})"
_LOSS = f"""ls AS (SELECT 'VaR 99.0%, tick loss' AS loss, model, date, {_TICK('var_99', A99)} AS value FROM fc
  UNION ALL SELECT 'VaR 97.5%, tick loss', model, date, {_TICK('var_97_5', A975)} FROM fc
  UNION ALL SELECT 'VaR and ES 97.5%, FZ0 loss', model, date, CASE WHEN ret <= -var_97_5 THEN (-var_97_5 - ret) / ({A975!r} * es_97_5) ELSE 0 END + var_97_5 / es_97_5 + ln(es_97_5) - 1 FROM fc)"""


def two_model_losses(spark, sf_dir) -> DataFrame:
    return losses.risk_losses(two_models(spark, sf_dir), LEVELS, ES)


@query("risk_losses", ctes("px", "ret", more=f"{_FC}, {_LOSS}") + " SELECT 'ALL' AS symbol, loss, model, date, round(value, 6) AS value FROM ls")
def risk_losses(spark, sf_dir):
    return rounded(two_model_losses(spark, sf_dir))


_RANK = "m AS (SELECT loss, model, avg(value) AS mean_loss, count(*) AS days FROM ls GROUP BY ALL), k AS (SELECT *, max(mean_loss) FILTER (model = 'EWMA-0.94') OVER (PARTITION BY loss) AS base, rank() OVER (PARTITION BY loss ORDER BY mean_loss) AS rk, count(*) OVER (PARTITION BY loss, mean_loss) AS ties FROM m)"


@query("loss_ranks", ctes("px", "ret", more=f"{_FC}, {_LOSS}, {_RANK}") + " SELECT 'ALL' AS symbol, loss, model, round(mean_loss, 6) AS mean_loss, days, floor(rk + (ties - 1) / 2)::BIGINT AS rank, round(mean_loss / base - 1, 6) AS vs_benchmark FROM k")
def loss_ranks(spark, sf_dir):
    return rounded(losses.ranked(two_model_losses(spark, sf_dir), BENCHMARK))


_DIFF = "df AS (SELECT a.loss, a.model, a.date, a.value - b.value AS diff FROM ls a JOIN ls b ON a.loss = b.loss AND a.date = b.date AND b.model = 'EWMA-0.94' WHERE a.model <> 'EWMA-0.94')"


@query("cumulative_loss", ctes("px", "ret", more=f"{_FC}, {_LOSS}, {_DIFF}") + " SELECT 'ALL' AS symbol, loss, model, date, round(sum(diff) OVER (PARTITION BY loss, model ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS cumulative FROM df")
def cumulative_loss(spark, sf_dir):
    return rounded(losses.cumulative(two_model_losses(spark, sf_dir), BENCHMARK))


_DM = """st AS (SELECT loss, model, avg(diff) AS md, count(*) AS n FROM df GROUP BY ALL),
u AS (SELECT df.loss, df.model, date, diff - md AS u, md, n, floor(4 * pow(n / 100, 2 / 9)) AS lags, row_number() OVER (PARTITION BY df.loss, df.model ORDER BY date) AS i FROM df JOIN st ON st.loss = df.loss AND st.model = df.model),
g AS (SELECT a.loss, a.model, a.md, a.n, a.lags, a.i - b.i AS k, sum(a.u * b.u) AS s FROM u a JOIN u b ON a.loss = b.loss AND a.model = b.model AND b.i BETWEEN a.i - 30 AND a.i WHERE a.i - b.i <= a.lags GROUP BY a.loss, a.model, a.md, a.n, a.lags, a.i - b.i),
w AS (SELECT loss, model, md, n, lags, sqrt(sum(CASE WHEN k = 0 THEN s ELSE 2 * (1 - k / (lags + 1)) * s END) / n / n) AS se FROM g GROUP BY loss, model, md, n, lags)"""


@query("diebold_mariano", ctes("px", "ret", more=f"{_FC}, {_LOSS}, {_DIFF}, {_DM}") + f" SELECT 'ALL' AS symbol, loss, model, {R('md AS mean_diff', 'md / se AS t_stat')}, round({ERFC('(abs(md / se) / sqrt(2.0))')}, 6) AS p_value, lags::INTEGER AS lags FROM w")
def diebold_mariano(spark, sf_dir):
    return rounded(losses.diebold_mariano(two_model_losses(spark, sf_dir), BENCHMARK))


@query("loss_matrix", ctes("px", "ret", more=f"{_FC}, {_LOSS}") + """ SELECT 'ALL' AS symbol, date, round(max(value) FILTER (model = 'HS-250'), 6) AS "HS-250", round(max(value) FILTER (model = 'EWMA-0.94'), 6) AS "EWMA" FROM ls WHERE loss = 'VaR 99.0%, tick loss' GROUP BY date""")
def loss_matrix(spark, sf_dir):
    wide = losses.loss_matrix(two_model_losses(spark, sf_dir), "VaR 99.0%, tick loss", ["HS-250", BENCHMARK])
    return rounded(wide.select("symbol", "date", "HS-250", F.col(f"`{BENCHMARK}`").alias("EWMA")))


_SPLIT = "1999-01-01"


@query(
    "period_ranks",
    ctes("px", "ret", more=f"{_FC}, {_LOSS}")
    + f""", pm AS (SELECT date < DATE '{_SPLIT}' AS early, loss, model, avg(value) AS m FROM ls GROUP BY ALL), pk AS (SELECT *, rank() OVER (PARTITION BY early, loss ORDER BY m) AS k FROM pm)
SELECT 'ALL' AS symbol, loss, model, coalesce(max(k) FILTER (early)::VARCHAR, '-') || ' -> ' || coalesce(max(k) FILTER (NOT early)::VARCHAR, '-') AS "rank" FROM pk GROUP BY loss, model""",
)
def period_ranks(spark, sf_dir):
    """Ranks by mean loss before and after a day, side by side."""
    every = two_model_losses(spark, sf_dir)
    before, after = (losses.ranked(every.filter(c)) for c in (F.col("date") < F.lit(_SPLIT).cast("date"), F.col("date") >= F.lit(_SPLIT).cast("date")))
    return losses.paired(before, after, "rank")


@query(
    "sql_functions",
    ctes("px", "ret", more=f"{_FC}, {_LOSS}") + " SELECT model, date, " + ", ".join(f"round(max(value) FILTER (loss = '{n}'), 6) AS {c}" for n, c in (("VaR 99.0%, tick loss", "tick"), ("VaR and ES 97.5%, FZ0 loss", "fz0"))) + " FROM ls GROUP BY model, date",
)
def sql_functions(spark, sf_dir):
    """The losses by the functions registered for SQL."""
    sql.register(spark)
    made = spark.sql("SELECT model, date, tick_loss(ret, var_99, :a) AS tick, fz0_loss(ret, var_97_5, es_97_5, :b) AS fz0 FROM {f}", args={"a": A99, "b": A975}, f=two_models(spark, sf_dir))
    return rounded(made)


_VL = "vm AS (SELECT 'GJR' AS model, date, ret, sigma2 AS s2 FROM gp), pr AS (SELECT date, ret * ret AS sq FROM ret)"


@query(
    "variance_losses",
    ctes("px", "ret", more=f"{_GJR}, {_VL}") + " SELECT 'ALL' AS symbol, 'variance, QLIKE vs sq_ret' AS loss, model, date, round(ln(s2) + sq / s2, 6) AS value FROM vm JOIN pr USING (date) UNION ALL SELECT 'ALL', 'variance, MSE vs sq_ret', model, date, round(pow(s2 - sq, 2), 4) FROM vm JOIN pr USING (date)",
)
def variance_losses(spark, sf_dir):
    """A GJR path, the same path under another name (dropped as a duplicate) and a model without variances."""
    path = forecasts.gjr_path(views.ret_daily(spark, sf_dir), **GJR).withColumn("sigma", F.sqrt("sigma2"))
    models = path.select("symbol", F.explode(F.array(*map(F.lit, ("GJR", "GJR again", "none")))).alias("model"), "date", "ret", "sigma")
    models = models.withColumn("sigma", F.when(F.col("model") != "none", F.col("sigma")))
    proxies = views.ret_daily(spark, sf_dir).select("symbol", "date", (F.col("ret") * F.col("ret")).alias("sq_ret"))
    out = losses.variance_losses(models, proxies, "sq_ret")
    return out.withColumn("value", F.when(F.col("loss").contains("MSE"), F.round("value", 4)).otherwise(F.round("value", 6)))


@query("model_confidence_set")
def model_confidence_set(spark, sf_dir):
    return rounded(losses.model_confidence_set(two_model_losses(spark, sf_dir)))


@query("model_comparison")
def model_comparison(spark, sf_dir):
    return rounded(losses.decision(losses.comparison(two_model_losses(spark, sf_dir), BENCHMARK), BENCHMARK))


# --- macro ---

_MONTHLY = "mm AS (SELECT date_trunc('month', date)::DATE AS m, avg(value) AS value, last_day(date_trunc('month', date)::DATE) AS release FROM macro GROUP BY 1, 3 HAVING count(value) >= 10)"


@query("macro_monthly_mean", ctes("macro", more=_MONTHLY) + " SELECT 'orders' AS variable, m AS reference_month, round(value, 6) AS value, release AS release_date FROM mm")
def macro_monthly_mean(spark, sf_dir):
    return rounded(macro.monthly_mean(views.macro_daily(spark, sf_dir)))


_GROWTH = """fi AS (SELECT date AS m, arg_min(value, rs) AS now, min(rs) AS released FROM vintages GROUP BY 1),
gr AS (SELECT fi.m, now, released, arg_max(v.value, v.rs) AS was FROM fi JOIN vintages v ON v.date = (fi.m - INTERVAL 1 MONTH)::DATE AND v.rs <= released AND (v.re IS NULL OR v.re >= released) GROUP BY ALL)"""


@query("macro_growth", ctes("mo", "vintages", more=_GROWTH) + " SELECT 'orders' AS variable, m AS reference_month, round(100 * ln(now / was), 6) AS value, released AS release_date FROM gr")
def macro_growth(spark, sf_dir):
    return rounded(macro.real_time_growth(views.macro_vintages(spark, sf_dir)))


@query("macro_summary", ctes("macro", more=_MONTHLY) + f""" SELECT 'orders' AS variable, count(*) AS months, min(m) AS "first", max(m) AS "last", {R('avg(value) AS mean', 'stddev_samp(value) AS sd')} FROM mm""")
def macro_summary(spark, sf_dir):
    return rounded(macro.summary(macro.monthly_mean(views.macro_daily(spark, sf_dir))))


def _lags(spark, sf_dir) -> DataFrame:
    monthly = macro.monthly_mean(views.macro_daily(spark, sf_dir))
    return macro.available_lags(monthly, monthly.select(F.col("reference_month").alias("month")), LAGS)


_LAGS = f"""kn AS (SELECT a.m AS month, b.m AS ref, b.value, row_number() OVER (PARTITION BY a.m ORDER BY b.m DESC) AS k FROM mm a LEFT JOIN mm b ON b.release < a.m),
lg AS (SELECT month, CASE WHEN count(ref) >= {LAGS} THEN list(value ORDER BY k) FILTER (k <= {LAGS}) END AS lags, max(ref) AS latest FROM kn GROUP BY month)"""


@query("macro_lags", ctes("macro", more=f"{_MONTHLY}, {_LAGS}") + f" SELECT 'orders' AS variable, month, latest AS latest_reference_month, round(lags[1], 6) AS lag_1, round(lags[{LAGS}], 6) AS lag_{LAGS}, round(list_sum(lags), 6) AS total FROM lg")
def macro_lags(spark, sf_dir):
    lags = F.col("lags")
    total = F.aggregate("lags", F.lit(0.0), lambda a, v: a + v)
    return rounded(_lags(spark, sf_dir).select("variable", "month", "latest_reference_month", lags[0].alias("lag_1"), lags[LAGS - 1].alias(f"lag_{LAGS}"), total.alias("total")))


def _lagged(spark, sf_dir) -> DataFrame:
    """Returns of the months whose lags are complete, with them."""
    full = _lags(spark, sf_dir).filter("lags is not null")
    days = views.ret_daily(spark, sf_dir).join(full.select(F.col("month").alias("m")), F.trunc("date", "MM") == F.col("m"), "left_semi")
    return macro.daily_lags(days, full, check=False)


_WEIGHTED = f"""bw AS (SELECT list_transform(range(1, {LAGS + 1}), lambda k: pow(1 - k / {LAGS + 1.0}, {MIDAS_W - 1})) AS raw),
dx AS (SELECT ret.date, ret, list_dot_product(lags, list_transform(raw, lambda r: r / list_sum(raw))) AS x FROM ret JOIN lg ON lg.month = date_trunc('month', ret.date)::DATE, bw WHERE lags IS NOT NULL)"""


@query("macro_daily_weighted", ctes("px", "ret", "macro", more=f"{_MONTHLY}, {_LAGS}, {_WEIGHTED}") + " SELECT 'ALL' AS symbol, 'orders' AS variable, date, round(x, 6) AS x FROM dx")
def macro_daily_weighted(spark, sf_dir):
    return rounded(macro.weighted(_lagged(spark, sf_dir), MIDAS_W, LAGS).select("symbol", "variable", "date", "x"))


_MP = f"""o AS (SELECT date, ret, ret - {MIDAS['mu']} AS e, exp({MIDAS['m0']} + {MIDAS['theta']} * x) AS tau, row_number() OVER (ORDER BY date) AS n FROM dx), mu AS (SELECT avg(ret) AS m FROM dx),
bc AS (SELECT sum(pow(ret - m, 2) * pow(0.94, n - 1)) / sum(pow(0.94, n - 1)) AS b FROM o, mu WHERE n <= 75),
gg AS (SELECT 1::BIGINT AS n, 1 - ({MIDAS['alpha']} + {MIDAS['gamma']} / 2 + {MIDAS['beta']}) + ({MIDAS['alpha']} + {MIDAS['gamma']} / 2 + {MIDAS['beta']}) * b / tau AS g FROM bc, o WHERE o.n = 1
  UNION ALL SELECT o.n + 1, 1 - ({MIDAS['alpha']} + {MIDAS['gamma']} / 2 + {MIDAS['beta']}) + ({MIDAS['alpha']} + {MIDAS['gamma']} * (e < 0)::INTEGER) * e * e / tau + {MIDAS['beta']} * g FROM gg JOIN o ON o.n = gg.n)"""


@query("midas_fixed_path", ctes("px", "ret", "macro", more=f"{_MONTHLY}, {_LAGS}, {_WEIGHTED}, {_MP}") + f" SELECT 'ALL' AS symbol, date, {R('ret', 'tau', 'g')} FROM gg JOIN o USING (n)")
def midas_fixed_path(spark, sf_dir):
    return rounded(forecasts.midas_path(macro.weighted(_lagged(spark, sf_dir), MIDAS_W, LAGS), **MIDAS))


@query("midas_variance_ratio", ctes("px", "ret", "macro", more=f"{_MONTHLY}, {_LAGS}, {_WEIGHTED}, {_MP}") + f" SELECT 'ALL' AS symbol, {R('var_pop(ln(tau)) / var_pop(ln(tau * g)) AS variance_ratio', 'exp(0.4 * stddev_pop((ln(tau) - 3.0) / 0.4) / 2) - 1 AS effect')} FROM gg JOIN o USING (n)")
def midas_variance_ratio(spark, sf_dir):
    path = forecasts.midas_path(macro.weighted(_lagged(spark, sf_dir), MIDAS_W, LAGS), **MIDAS)
    x = (F.ln("tau") - MIDAS["m0"]) / MIDAS["theta"]
    return rounded(path.groupBy("symbol").agg((F.var_pop(F.ln("tau")) / F.var_pop(F.ln(F.col("tau") * F.col("g")))).alias("variance_ratio"), (F.exp(MIDAS["theta"] * F.stddev_pop(x) / 2) - 1).alias("effect")))


# --- estimation: likelihoods are maximised numerically, so rows only ---


@query("garch_fits")
def garch_fits(spark, sf_dir):
    return forecasts.fit_statistics(forecasts.fits(views.ret_daily(spark, sf_dir), errors=False))


@query("garch_parameters")
def garch_parameters(spark, sf_dir):
    return forecasts.t_statistics(forecasts.fits(views.ret_daily(spark, sf_dir)))


@query("likelihood_ratio_tests")
def likelihood_ratio_tests(spark, sf_dir):
    return forecasts.likelihood_ratios(forecasts.fits(views.ret_daily(spark, sf_dir), errors=False))


@query("residual_checks")
def residual_checks(spark, sf_dir):
    r = forecasts.residuals(forecasts.fits(views.ret_daily(spark, sf_dir), errors=False))
    return rounded(stylized.distribution_summary(r, "x").join(stylized.arch_lm(r, "x").select("symbol", F.col("lm").alias("arch_lm"), F.col("p_value").alias("arch_p")), "symbol"))


def _rolled(spark, sf_dir) -> DataFrame:
    r = views.ret_daily(spark, sf_dir)
    params = forecasts.refits(r, SETTINGS)
    return forecasts.garch_forecasts(r, SETTINGS, params, fhs="GJR-GARCH(1,1)-normal")


@query("garch_rolling_forecasts")
def garch_rolling_forecasts(spark, sf_dir):
    return _rolled(spark, sf_dir)


@query("garch_refits")
def garch_refits(spark, sf_dir):
    return forecasts.refit_summary(forecasts.refits(views.ret_daily(spark, sf_dir), SETTINGS))


@query("garch_rolling_summary")
def garch_rolling_summary(spark, sf_dir):
    return rounded(forecasts.forecast_summary(_rolled(spark, sf_dir), SETTINGS))


@query("midas_forecasts")
def midas_forecasts(spark, sf_dir):
    out, _ = forecasts.midas_forecasts(_lagged(spark, sf_dir), SETTINGS, LAGS)
    return out


@query("bars_from_stream", ctes("bars") + " SELECT date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars")
def bars_from_stream(spark, sf_dir):
    from varloom.streaming import bars

    return rounded(bars.run_once(spark, f"{sf_dir}/events.parquet"))


SPECS = vol.SPECS
