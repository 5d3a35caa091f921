"""Data-quality checks of price bars: every check of a row in one scan and one window stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.columns import clean
from varloom.operators.returns import OHLC, require

COLUMNS = ("symbol", "date", "check", "severity", "detail")
FLAT = "open, high, low and close are identical (possible placeholder data)"


def _found(when: Column, check: str, severity: str, detail, seq: int) -> Column:
    """A finding where the predicate is true (null and false give none)."""
    detail = detail if isinstance(detail, Column) else F.lit(detail)
    return F.when(when, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"), F.lit(seq).alias("seq")))


def findings(bars: DataFrame, large_move: float = 0.07, tolerance: float = 1e-5, calendar: DataFrame | None = None) -> DataFrame:
    """(symbol, date, check, severity, detail), ordered by date, check and rule.

    Optional columns (volume, adj_close, div_cash, split_factor) switch their
    checks on.  calendar is (date) of the trading days, for all symbols.
    """
    require(bars, "symbol", "date", *OHLC)
    has = set(bars.columns)
    numbers = [c for c in (*OHLC, "volume", "adj_close", "div_cash", "split_factor") if c in has]
    b = bars.select("symbol", "date", *(clean(F.col(c)).alias(c) for c in numbers))
    # Equal dates keep the order in which they are read only up to their values; all but one are flagged.
    w = Window.partitionBy("symbol").orderBy("date", *numbers)
    price = "adj_close" if "adj_close" in has else "close"
    b = b.withColumn("before", F.lag(price).over(w)).withColumn("same", F.lag("date").over(w) == F.col("date"))
    o, h, l, c = (F.col(x) for x in OHLC)
    both = o.isNotNull() & c.isNotNull()
    rules = [_found(F.col("same"), "duplicate_date", "error", "date appears more than once", 0)]
    rules += [_found(F.col(x).isNull(), "missing_value", "error", f"{x} is missing", 10 + i) for i, x in enumerate(OHLC)]
    rules += [_found(F.col(x) <= 0, "non_positive_price", "error", f"{x} is zero or negative", 20 + i) for i, x in enumerate(OHLC)]
    rules += [
        _found(h < l, "ohlc_inconsistent", "error", "high is below low", 30),
        _found(both & (h < F.greatest(o, c)), "ohlc_inconsistent", "error", "high is below open or close", 31),
        _found(both & (l > F.least(o, c)), "ohlc_inconsistent", "error", "low is above open or close", 32),
        _found((o == h) & (h == l) & (l == c), "flat_bar", "review", FLAT, 40),
    ]
    if "volume" in has:
        rules.append(_found(F.col("volume") == 0, "zero_volume", "review", "volume is zero", 50))
    now, prev = F.col(price), F.col("before")
    move = F.ln(F.try_divide(now, prev))
    # The logarithm of a price of zero is infinite: one such price is a large move, two are none.
    rules += [
        _found(F.abs(move) > large_move, "large_move", "review", F.format_string("daily log return of %+.2f%%", move * 100), 60),
        _found((now == 0) & (prev > 0), "large_move", "review", "daily log return of -inf%", 60),
        _found((prev == 0) & (now > 0), "large_move", "review", "daily log return of +inf%", 60),
    ]
    if {"adj_close", "div_cash", "split_factor"} <= has:
        factor = F.try_divide(F.col("adj_close"), F.col("close"))
        b = b.withColumn("factor", factor).withColumn("factor_before", F.lag(factor).over(w))
        comparable = F.col("factor_before").isNotNull()
        changed = F.coalesce(F.abs(F.try_divide(F.col("factor"), F.col("factor_before")) - 1) > tolerance, F.lit(False))
        action = F.coalesce(F.col("div_cash") > 0, F.lit(False)) | ~F.col("split_factor").eqNullSafe(F.lit(1.0))
        rules += [
            _found(changed & ~action & comparable, "adjustment_unexplained", "error", "adjustment factor changes with no dividend or split", 70),
            _found(action & ~changed & comparable, "adjustment_missing", "error", "dividend or split with no change in adjustment factor", 71),
        ]
    out = b.select("symbol", "date", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("f")).select("symbol", "date", "f.check", "f.severity", "f.detail", "f.seq")
    if calendar is not None:
        out = out.unionByName(calendar_findings(bars, calendar))
    return out.orderBy("symbol", "date", "check", "seq").select(*COLUMNS)


def calendar_findings(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days without a bar, and bars on other days."""
    seen = bars.select("symbol", "date").distinct()
    days = calendar.select("date").distinct()
    wanted = seen.select("symbol").distinct().crossJoin(F.broadcast(days))  # symbols x days is the size of the result's domain
    missing = wanted.join(seen, ["symbol", "date"], "left_anti").select("symbol", "date", F.lit("missing_trading_day").alias("check"), F.lit("error").alias("severity"), F.lit("exchange was open but the date is missing").alias("detail"), F.lit(80).alias("seq"))
    extra = seen.join(days, "date", "left_anti").select("symbol", "date", F.lit("not_a_trading_day").alias("check"), F.lit("error").alias("severity"), F.lit("date is not an exchange trading day").alias("detail"), F.lit(81).alias("seq"))
    return missing.unionByName(extra)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n"))
