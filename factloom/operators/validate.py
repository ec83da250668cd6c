"""Invariants of facts, as rows of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(name) == "")


def invariants(facts: DataFrame) -> DataFrame:
    """(fact_id, message): one row for each broken rule of each fact."""
    rules = [
        (_blank("fact_id"), "fact id is empty"),
        (_blank("subject"), "subject is empty"),
        (_blank("relation"), "relation is empty"),
        (_blank("context"), "context is empty"),
        (F.col("confidence").isNull() | (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence is not within 0 and 1"),
        (F.col("valid_end").isNotNull() & F.col("valid_start").isNull(), "interval ends without a start"),
        (F.col("valid_end") < F.col("valid_start"), "interval ends before it starts"),
    ]
    broken = F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in rules)))
    return facts.select("fact_id", F.explode(broken).alias("message"))


def duplicates(facts: DataFrame) -> DataFrame:
    """(fact_id, n) of ids with more than one row."""
    return facts.groupBy("fact_id").agg(F.count("*").alias("n")).where("n > 1")


def dangling(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(fact_id, ref): references to nothing known; without a table of entities (column ``entity``), facts' own ids are what is known."""
    refs = facts.select("fact_id", F.explode("objects").alias("v")).where("v.kind = 'ref'").select("fact_id", F.col("v.ref").alias("ref"))
    ids = facts.select(F.col("fact_id").alias("ref")) if known is None else known.select(F.col("entity").alias("ref"))
    return refs.join(ids, "ref", "left_anti").select("fact_id", "ref")


def role_matches(slot: Column, expected: str | None) -> Column:
    """Whether a slot has the expected semantic type; no expectation always matches."""
    if expected is not None and expected not in V.SEMANTIC_TYPES:
        raise ValueError(f"unknown semantic type {expected!r}")
    return F.lit(True) if expected is None else slot["type_hint"] == expected


def report(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(fact_id, message) over all rules, duplicate ids and dangling references."""
    twice = duplicates(facts).select("fact_id", F.lit("fact id is not unique").alias("message"))
    lost = dangling(facts, known).select("fact_id", F.concat(F.lit("reference to nothing known: "), "ref").alias("message"))
    return invariants(facts).unionByName(twice).unionByName(lost)
