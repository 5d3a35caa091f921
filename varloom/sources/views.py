"""Series of the test tables in the engine's own layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_hourly(spark, sf_dir) -> DataFrame:
    """(symbol, date, open, high, low, close, volume): hourly bars of the events' positive values."""
    e = table(spark, sf_dir, "events").filter("value > 0").select("ts", "value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("volume")
    ).select(F.lit("EVENTS").alias("symbol"), "*")


def px_daily(spark, sf_dir) -> DataFrame:
    """(symbol, date, px): the mean unit price by ship date."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("px"))
        .select(F.lit("ALL").alias("symbol"), "date", "px")
    )


def panel_daily(spark, sf_dir) -> DataFrame:
    """px_daily by the supplier's region; the dimension tables are joined first, prices are aggregated once."""
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.col("r_name").alias("symbol"))
    )
    by_supplier = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_extendedprice").alias("amount"), F.sum("l_quantity").alias("units"))
    return by_supplier.join(place, "l_suppkey").groupBy("symbol", "date").agg((F.sum("amount") / F.sum("units")).alias("px"))


def ret_daily(spark, sf_dir, scale: float = 100.0) -> DataFrame:
    """(symbol, date, ret) of px_daily; the first row of a series has no return and is dropped."""
    return returns_of(px_daily(spark, sf_dir), scale)


def returns_of(prices: DataFrame, scale: float = 100.0) -> DataFrame:
    from varloom.functions.columns import log_return, series

    w = series()
    return (
        prices.withColumn("ret", log_return(F.col("px"), F.lag("px").over(w), scale))
        .withColumn("n", F.row_number().over(w))
        .filter("n > 1")
        .select("symbol", "date", "ret")
    )


def macro_daily(spark, sf_dir) -> DataFrame:
    """(variable, date, value): the mean order value by day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg((F.avg("o_totalprice") / 100000).alias("value"))
        .select(F.lit("orders").alias("variable"), "date", "value")
    )


def macro_vintages(spark, sf_dir) -> DataFrame:
    """(variable, date, value, realtime_start, realtime_end): a first figure by month and its revision."""
    months = (
        table(spark, sf_dir, "orders")
        .groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("date"))
        .agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("first"), F.sum("o_totalprice").alias("final"))
    )
    end = F.last_day("date")
    both = months.select(
        "date",
        F.explode(
            F.array(
                F.struct(F.col("first").alias("value"), F.date_add(end, 15).alias("realtime_start"), F.date_add(end, 45).alias("realtime_end")),
                F.struct(F.col("final").alias("value"), F.date_add(end, 46).alias("realtime_start"), F.lit(None).cast("date").alias("realtime_end")),
            )
        ).alias("v"),
    )
    return both.select(F.lit("orders").alias("variable"), "date", "v.*").filter("value is not null")


#: The same series as DuckDB CTEs, for the oracles.
SQL = {
    "bars": """bars AS (SELECT date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume
  FROM events WHERE value > 0 GROUP BY 1)""",
    "px": "px AS (SELECT l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem GROUP BY 1)",
    "ret": """ret AS (SELECT date, ret FROM (SELECT date, 100 * ln(px / lag(px) OVER (ORDER BY date)) AS ret, row_number() OVER (ORDER BY date) AS n FROM px) WHERE n > 1)""",
    "panel": """panel AS (SELECT r_name AS symbol, l_shipdate::DATE AS date, sum(l_extendedprice) / sum(l_quantity) AS px FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)""",
    "macro": "macro AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) / 100000 AS value FROM orders GROUP BY 1)",
    "vintages": """vintages AS (SELECT * FROM (SELECT m AS date, f AS value, last_day(m) + 15 AS rs, last_day(m) + 45 AS re FROM mo UNION ALL SELECT m, t, last_day(m) + 46, NULL FROM mo) WHERE value IS NOT NULL)""",
    "mo": "mo AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS f, sum(o_totalprice) AS t FROM orders GROUP BY 1)",
}


def ctes(*names: str, more: str = "") -> str:
    return "WITH RECURSIVE " + ",\n".join([SQL[n] for n in names] + ([more] if more else []))
