"""Joins that facts need beyond plain equality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.temporal import overlap_seconds


def entity_pairs(edges: DataFrame, entities: DataFrame, relation: str) -> DataFrame:
    """Edges of ``relation`` whose both ends are among ``entities`` (column ``entity``)."""
    e = edges.where(F.col("relation") == relation)
    e = e.join(entities.select(F.col("entity").alias("src")), "src", "left_semi")
    return e.join(entities.select(F.col("entity").alias("dst")), "dst", "left_semi")


def high_arity_lookup(facts: DataFrame, relation: str, at: Mapping[int, object]) -> DataFrame:
    """Facts of ``relation`` with the given slots, by position; text and references compare as text, numbers as numbers."""
    out = facts.where(F.col("relation") == relation)
    for pos, value in at.items():
        slot = F.get("objects", F.lit(pos))
        out = out.where(V.as_number(slot) == value if isinstance(value, (int, float)) and not isinstance(value, bool) else V.as_text(slot) == value)
    return out


def high_arity_join(left: DataFrame, right: DataFrame, left_pos: int, right_pos: int) -> DataFrame:
    """Pairs (left_id, right_id) whose slots at the two positions are equal; two missing slots are equal too."""
    a = left.select(F.col("fact_id").alias("left_id"), V.canonical(F.get("objects", F.lit(left_pos))).alias("x"))
    b = right.select(F.col("fact_id").alias("right_id"), V.canonical(F.get("objects", F.lit(right_pos))).alias("y"))
    return a.join(b, a["x"].eqNullSafe(b["y"])).select("left_id", "right_id")


def interval_windows(facts: DataFrame, origin: str, width_days: int) -> DataFrame:
    """Each fact once for every tumbling window its interval meets: (window_start, ...).

    Windows are computed from the interval's own ends, so this is an explode of
    a handful of numbers per fact and never a join with all windows.
    """
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit(origin).cast("date"))
    first = F.floor(day("valid_start") / width_days)
    # The end is excluded: one microsecond before it decides the last window.
    last = F.floor(F.datediff((F.col("valid_end") - F.expr("interval 1 microsecond")).cast("date"), F.lit(origin).cast("date")) / width_days)
    rows = facts.where("valid_start is not null and valid_end > valid_start").withColumn("w", F.explode(F.sequence(first, last)))
    return rows.withColumn("window_start", F.date_add(F.lit(origin).cast("date"), (F.col("w") * width_days).cast("int")))


def overlaps_with(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Facts that overlap [start, end) strictly, with the overlap in seconds."""
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return facts.withColumn("overlap_seconds", overlap_seconds(F.col("valid_start"), F.col("valid_end"), lo, hi)).where("overlap_seconds is not null")
