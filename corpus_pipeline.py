"""The corpus pipeline: STAGES applied to ``documents``, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns the rows that stay.  All but
the last return the columns they were given; the last adds topic, tokens and p
and repeats documents where p, the expected number of copies, is above 1.

Defined results: an empty table gives an empty one at every stage; other
columns pass through, whatever they are called; a null text counts as an empty
one, which language identification drops, as it has no letter, and which is
near no other and holds no benchmark item; rows that repeat an id are rows of
their own, of which exact dedup keeps one a text; a row without an id is kept
by near dedup and decontamination as its text is by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from factloom.llm.work import Workspace, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those the calibrated model rejects, go."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to the case of A-Z, the one with the largest id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more on five-word shingles, the one with the smallest id stays."""
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn, scarce ones repeatedly, so that sources, languages and topics meet their target shares of tokens."""
    ship(spark)
    return mixing.fill(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the trained and sketch-based stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = ws.table(docs, name)
            if k:
                ws.drop(STAGES[k - 1][0])
    return docs
