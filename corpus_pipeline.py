"""A corpus pipeline of five stages; each reads what the one before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns
of ``documents``; the last one returns a row for each copy that the mix takes, numbered by ``copy``.

Every stage takes null ids, texts, languages and sources, empty texts, repeated rows, further columns
and tables without rows: toxicity and leaks judge each row for itself, a null text as an empty one;
copies of null and empty texts are copies of one another, near copies they never are; of equal or
similar rows the one that the stage's operator names stays, exactly one of repeated rows; the mix
takes rows without words 0 times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recscan.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from recscan.llm.shared import last_written, materialize, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    return toxicity.keep_civil(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five words, 0.8)."""
    return simhash.near_dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their targets: each taken document once per copy."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mixing", mix_sources),
]

#: The near-dedup and mixing stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; other scratch tables are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), name)
            kept.append(last_written())
    return docs
