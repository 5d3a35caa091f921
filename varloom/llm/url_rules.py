"""URL filters [native]: a sort-merge range join of URLs and host/path rules.

A host is keyed by its labels in reverse, each followed by a dot:
``a.example.com`` becomes ``com.example.a.``.  A rule's host and all its
subdomains are then exactly the keys from ``com.example.`` up to
``com.example/`` ('/' follows '.').  Rule intervals are nested or disjoint, so a
sweep in key order keeps a stack of the open rules; each stretch between two
rule ends has one stack.  URLs are range partitioned by (key, path, id), so one
hot host spreads over many tasks, and each takes the stack of the last stretch
that began at or before its key.  Of the stack's rules whose path begins the
URL's path, the one with the longest host, then the longest path, decides.
Everything is DataFrame functions; rules and URLs are both shuffled, nothing is
broadcast.

Defined results: a URL that is null or has no ``://`` has an empty host and
path, no rule and the default verdict.  Equal rules that disagree: block wins.
Null rule hosts, paths or verdicts drop that rule.  Ties and repeated URLs are
kept row by row; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import load, written

RULES_SCHEMA = "rule_host string, rule_path string, rule_verdict string"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lowered, path up to ? or #); both empty without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.substring(rest, F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def stretches(rules: DataFrame) -> DataFrame:
    """(begin, stack): from key begin on, until the next begin, the stack's rules are open."""
    known = (
        rules.select("rule_host", "rule_path", "rule_verdict")
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
    )
    key = host_key(F.col("rule_host"))
    nodes = known.select(
        key.alias("open"),
        F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/")).alias("close"),
        F.struct(F.length("rule_host").alias("host_len"), F.length("rule_path").alias("path_len"), "rule_host", "rule_path", "rule_verdict").alias("rule"),
    )
    # A rule is open in the stretch that begins at its own key, at the keys of rules below it, and at their ends.
    marks = nodes.select(F.col("open").alias("begin")).union(nodes.select(F.col("close").alias("begin"))).distinct()
    # The open rules of a mark are those of the mark's own prefixes: an equi-join on the label chain, no range scan.
    labels = F.split(F.regexp_replace("begin", r"/$", "."), r"\.", -1)
    chain = F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1),
        lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")),
    )
    links = marks.select("begin", F.explode(chain).alias("open"))
    return (
        marks.join(
            links.join(nodes, "open")
            .filter((F.col("begin") >= F.col("open")) & (F.col("begin") < F.col("close")))
            .groupBy("begin")
            .agg(F.sort_array(F.collect_list("rule"), asc=False).alias("stack")),
            "begin",
            "left",
        )
        .withColumn("stack", F.coalesce("stack", F.expr("array()").cast("array<struct<host_len:int,path_len:int,rule_host:string,rule_path:string,rule_verdict:string>>")))
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row of pages; see the module's text."""
    n = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    empty = stretches(rules)
    points = urls.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast(empty.schema["stack"].dataType).alias("stack"))
    begins = empty.select(F.col("begin").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    # Dealt once and written: the sweep and what is carried over its parts' edges see the same parts.
    dealt = points.union(begins).repartitionByRange(n, "key", "kind", "path", "id").withColumn("part", F.spark_partition_id())
    ranged = written(dealt, "url-ranges")
    order = Window.partitionBy("part").orderBy("key", "kind")
    swept = ranged.withColumn("own", F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # The stretch that is open where a part begins: the last one of any part before it.  One row a part.
    ends = ranged.filter("kind = 0").groupBy("part").agg(F.max(F.struct("key", "stack")).alias("last"))
    parts = F.sequence(F.lit(0), F.lit(n - 1))
    carried = (
        pages.sparkSession.range(1)
        .select(F.explode(parts).alias("part"))
        .join(ends, "part", "left")
        .select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))["stack"].alias("carry"))
    )
    stacked = swept.filter("kind = 1").join(carried, "part", "left").withColumn("stack", F.coalesce("own", "carry"))
    fitting = F.filter("stack", lambda r: F.col("path").startswith(r["rule_path"]))
    best = F.try_element_at(fitting, F.lit(1))
    return stacked.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.concat(best["rule_host"], best["rule_path"]).alias("rule"),
        F.coalesce(best["rule_verdict"], F.lit(default)).alias("verdict"),
    )


#: The rules of the contract (host, path, verdict).
CONTRACT_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op9_url_rules(spark, sf_dir):
    rules = spark.createDataFrame(CONTRACT_RULES, RULES_SCHEMA)
    return judge(load(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(h, p, v) AS (
  VALUES ('com','/','allow'), ('example.com','/en/','block'), ('www.example.com','/en/','allow'), ('net','/es/','block'), ('net','/fr/','block')
), fit AS (
  SELECT page_id, arg_max(h || p, length(h) * 1000 + length(p)) AS rule, arg_max(v, length(h) * 1000 + length(p)) AS verdict
  FROM part JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT part.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM part LEFT JOIN fit ON part.page_id = fit.page_id
"""
