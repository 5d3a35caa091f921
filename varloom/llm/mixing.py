"""Mixing sources to target weights [native]: temperature mixing and budgeted block permutations.

Source token shares p are raised to an exponent a and normalised to weights.
The exponent is found by bisection: the largest-spread mix (smallest a in
[0, 1]) that repeats no source more than ``repeat_limit`` times, or the a in
[0, ``STEEPEST``] whose weights have the entropy ``target_entropy`` (in nats); over
1, large sources gain.  A token budget times the
weight is a source's target.  It is realised in epochs: every full epoch takes
all rows of the source, in an order of blocks permuted anew, and the last one takes
blocks in permuted order until the target, cutting the block that crosses it by
row, in an order permuted too.

Scale: rows are dealt to about ``docs / BLOCK_ROWS`` blocks by a hash of the id,
alike for all sources, so a hot source spreads over many (source, block) groups;
running sums over blocks see one row for each block, those over rows one block for
each source.  One row holds an entry for each source during the bisection, so
the number of sources has to be at most ``MAX_SOURCES``; that bounds what is
broadcast (a source's epochs and where its last one ends), and texts are not shuffled.

Defined results: a null source is a source named ''; null and empty texts have
no tokens and are taken whenever their turn comes; a source without any token has
no weight; equal ids stay together in order; an entropy that no exponent in the range has gives
the end of the range next to it; without a target entropy, a budget over
``repeat_limit`` times all tokens is not spent in full: every source is taken
``repeat_limit`` times; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import load, written

BLOCK_ROWS = 1000
MAX_SOURCES = 100_000
REPEAT_LIMIT = 4.0
STEPS = 50
STEEPEST = 64.0
OUT = ("source", "epoch", "block", "block_order", "n_tokens")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def _weights(shares: Column, a: Column) -> Column:
    raised = F.transform(shares, lambda p: F.pow(p, a))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def exponents(totals: DataFrame, budget: Column, repeat_limit: float | None, target_entropy: float | None) -> DataFrame:
    """(source, tokens, exponent, weight, target) for (source, tokens)."""
    row = (
        totals.filter("tokens > 0")
        .groupBy()
        .agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"), F.sum("tokens").alias("total"))
        .filter(F.size("s") > 0)
        .withColumn("s", F.when(F.size("s") <= MAX_SOURCES, F.col("s")).otherwise(F.raise_error(F.lit("too many sources to mix")).cast("array<struct<source:string,tokens:bigint>>")))
        .withColumn("budget", budget.cast("long"))
        # Weights are the same for shares of any whole; of the largest, none but small ones vanish when raised.
        .withColumn("whole", F.col("total") if target_entropy is None else F.array_max(F.transform("s", lambda x: x["tokens"])))
        .withColumn("p", F.transform("s", lambda x: x["tokens"].cast("double") / F.col("whole")))
    )

    def too_low(a: Column) -> Column:
        weights = _weights(F.col("p"), a)
        if target_entropy is None:
            repeats = F.zip_with(weights, F.col("s"), lambda w, x: w * F.col("budget") / x["tokens"])
            return F.array_max(repeats) > F.lit(float(repeat_limit))
        return F.aggregate(weights, F.lit(0.0), lambda s, w: s - F.when(w > 0, w * F.ln(w)).otherwise(0.0)) > F.lit(float(target_entropy))

    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(F.lit(0.0).alias("lo"), F.lit(1.0 if target_entropy is None else STEEPEST).alias("hi")),
        lambda s, _: F.when(too_low((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    found = row.withColumn("exponent", span["hi"]).withColumn("w", _weights(F.col("p"), F.col("exponent")))
    target = F.floor(F.col("x.w") * F.col("budget"))
    if target_entropy is None:
        target = F.least(target, F.floor(F.col("x.s.tokens") * F.lit(float(repeat_limit))))
    return found.select("exponent", "budget", F.explode(F.arrays_zip("s", "w")).alias("x")).select(
        F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), "exponent", F.col("x.w").alias("weight"), target.cast("long").alias("target")
    )


def mix(docs: DataFrame, budget_tokens: int | None = None, repeat_limit: float = REPEAT_LIMIT, target_entropy: float | None = None, seed: int = 0, block_rows: int = BLOCK_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, source, epoch, block, block_order, n_tokens: a row for each time a document is taken.

    A kept column named like one of the last five gives way to it.

    The budget is by default as many tokens as docs has.  Order by epoch and
    block_order gives the mixed order of a source.
    """
    n = 1 + docs.count() // block_rows
    block = F.pmod(F.conv(F.substring(_hash(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)), 1, 8), 16, 10).cast("long"), F.lit(n))
    kept = F.struct(*(c for c in keep if c not in OUT))
    rows = docs.select(kept.alias("kept"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"), block.alias("block"))
    blocks = written(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens")), "mix-blocks")
    totals = blocks.groupBy("source").agg(F.sum("block_tokens").alias("tokens"))
    budget = F.col("total") if budget_tokens is None else F.lit(budget_tokens)
    # Target by source: how many full epochs, and what is left for the last one.
    goals = (
        exponents(totals, budget, repeat_limit, target_entropy)
        .withColumn("full", F.expr("target div tokens"))
        .withColumn("rest", F.col("target") - F.col("full") * F.col("tokens"))
        .select("source", "full", "rest")
    )
    order = Window.partitionBy("source").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, 0)
    # The block of the last epoch that crosses the target: those before it are taken whole.
    cuts = (
        blocks.join(goals, "source")
        .withColumn("block_order", _turn(F.col("full") + 1, seed))
        .withColumn("room", F.col("rest") - (F.sum("block_tokens").over(order) - F.col("block_tokens")))
        .filter(F.col("room") < F.col("block_tokens"))
        .groupBy("source")
        .agg(F.first("full").alias("full"), F.min_by(F.struct("block_order", "block", "room"), F.struct("block_order", "block")).alias("at"))
    )
    # One row for each of at most MAX_SOURCES sources: broadcast, so that texts stay where they are.
    taken = (
        rows.join(F.broadcast(cuts), "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full") + 1)))
        .withColumn("block_order", _turn(F.col("epoch"), seed))
    )
    whole = (F.col("epoch") <= F.col("full")) | (F.col("block_order") < F.col("at.block_order"))
    edge = (F.col("epoch") > F.col("full")) & (F.col("block") == F.col("at.block")) & (F.col("at.room") > 0)
    inner = Window.partitionBy("source").orderBy(_hash(F.col("doc_id"), F.col("epoch"), F.lit(seed)), "doc_id", "n_tokens")
    cut = taken.filter(edge).withColumn("sum", F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("sum") <= F.col("at.room")).drop("sum")
    return taken.filter(whole).unionByName(cut).select("kept.*", *OUT)


def _turn(epoch: Column, seed: int) -> Column:
    """The key that orders a source's blocks in an epoch."""
    return _hash(F.col("source"), epoch, F.col("block"), F.lit(seed))


def op5_mix_sources(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR || '|0'), 1, 8))::BIGINT % (1 + (SELECT count(*) FROM documents) // 1000) AS block
  FROM documents
), b AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens FROM d GROUP BY ALL
), t AS (SELECT source, sum(block_tokens)::BIGINT AS tokens FROM b GROUP BY source HAVING sum(block_tokens) > 0
), total AS (SELECT sum(tokens)::BIGINT AS total FROM t
), one AS (SELECT list(tokens::DOUBLE / total ORDER BY source) AS p, list(tokens ORDER BY source) AS s, any_value(total) AS total FROM t, total
), walk AS (
  WITH RECURSIVE w(step, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT step + 1, CASE WHEN high THEN mid ELSE lo END, CASE WHEN high THEN hi ELSE mid END
    FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
      list_max(list_transform(range(1, len(p) + 1), lambda i: pow(p[i], (lo + hi) / 2) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) * total / s[i])) > 4.0 AS high
      FROM w, one WHERE step < 50)
  ) SELECT hi AS a FROM w WHERE step = 50
), goal AS (
  SELECT source, tokens, floor(pow(tokens::DOUBLE / total, a) / (SELECT list_sum(list_transform(p, lambda x: pow(x, a))) FROM one, walk) * total)::BIGINT AS target FROM t, total, walk
), g AS (SELECT source, target // tokens AS full_epochs, target - (target // tokens) * tokens AS rest FROM goal
), o AS (
  SELECT *, sum(block_tokens) OVER (PARTITION BY source ORDER BY block_order, block ROWS UNBOUNDED PRECEDING) - block_tokens AS before
  FROM (SELECT source, block, block_tokens, rest, full_epochs, md5(source || '|' || (full_epochs + 1) || '|' || block || '|0') AS block_order FROM b JOIN g USING (source))
), k AS (
  SELECT source, any_value(full_epochs) AS full_epochs, arg_min(block, block_order) AS at_block, min(block_order) AS at_order, arg_min(rest - before, block_order) AS room
  FROM o WHERE rest - before < block_tokens GROUP BY source
), t2 AS (
  SELECT doc_id, source, block, n_tokens, epoch, full_epochs, at_block, at_order, room, md5(source || '|' || epoch || '|' || block || '|0') AS block_order
  FROM (SELECT d.*, k.* EXCLUDE (source), unnest(range(1, full_epochs + 2)) AS epoch FROM d JOIN k ON k.source = d.source)
), c AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(doc_id || '|' || epoch || '|0'), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS s
  FROM t2 WHERE epoch > full_epochs AND block = at_block AND room > 0
)
SELECT doc_id, source, epoch::BIGINT AS epoch, block::BIGINT AS block, block_order, n_tokens FROM t2 WHERE epoch <= full_epochs OR block_order < at_order
UNION ALL SELECT doc_id, source, epoch::BIGINT, block::BIGINT, block_order, n_tokens FROM c WHERE s <= room
"""
