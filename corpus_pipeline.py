"""A corpus pipeline of five stages, each one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
every stage's rows as Parquet in the shared folder and reads them as the next
one's docs.  All but the last return the columns of documents.

1. toxicity: rows that the scorer, learned from labels, rejects go.
2. near duplicates: of every component one row, that of the least id, stays.
3. decontamination: rows in which a benchmark item occurs go.
4. secrets: every secret is masked in the text, n_chars follows; no row goes.
5. mixing: temperature mixing; the rows taken, with epoch, block, block_order and
   n_tokens, and the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import decontaminate, jaccard_join, mixing, secrets, toxicity
from varloom.llm.common import load, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    scorer = toxicity.learn(docs, labels.filter(~toxicity.held_out(labels["doc_id"])))
    return toxicity.clean(docs, scorer)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.clean(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, keep=tuple(docs.columns))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The scores of the toxicity stage and of the forest are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
