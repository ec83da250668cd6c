"""The ten contextual workloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import gluing, graph, joins


def touches(facts: DataFrame, first_object_only: bool = True) -> DataFrame:
    """(fact_id, entity): the subject and the first reference, or all references."""
    refs = F.filter("objects", lambda v: v["kind"] == "ref")
    refs = F.transform(F.slice(refs, 1, 1) if first_object_only else refs, lambda v: v["ref"])
    return facts.select("fact_id", F.explode(F.array_distinct(F.concat(F.array("subject"), refs))).alias("entity"))


def fact_neighborhood(facts: DataFrame, seeds: DataFrame, radius: int = 2) -> DataFrame:  # C1
    return graph.fact_neighborhood(touches(facts), seeds, radius)


def path_context(edges: DataFrame, source: str, target: str | None, length: int = 3) -> DataFrame:  # C2
    return graph.paths(edges, source, target, length)


def high_arity_lookup(facts: DataFrame, relation: str, at: Mapping[int, object]) -> DataFrame:  # C3
    return joins.high_arity_lookup(facts, relation, at)


def star_join(left: DataFrame, right: DataFrame, i: int, j: int) -> DataFrame:  # C4
    return joins.high_arity_join(left, right, i, j)


def interval_query(facts: DataFrame, start: str, end: str) -> DataFrame:  # C5
    return joins.overlaps_with(facts, start, end)


def temporal_aggregation(facts: DataFrame, origin: str, width_days: int, slot: int = 0) -> DataFrame:  # C6
    """Count and mean of a numeric slot for each window that a fact meets; see ``fill_windows`` for the empty ones."""
    w = joins.interval_windows(facts, origin, width_days)
    return w.groupBy("window_start").agg(F.count("*").alias("n"), F.coalesce(F.avg(V.as_number(F.get("objects", F.lit(slot)))), F.lit(0.0)).alias("mean"))


def fill_windows(found: DataFrame, start: str, end: str, width_days: int) -> DataFrame:
    """All windows from ``start`` up to ``end``; empty ones count 0 with mean 0."""
    days = F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr(f"interval {width_days} days"))
    every = found.sparkSession.range(1).select(F.explode(days).alias("window_start"))
    return every.join(found, "window_start", "left").select("window_start", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


def provenance_chain(derivations: DataFrame, start: DataFrame) -> DataFrame:  # C7
    return graph.chain(derivations, start)


def consistency(assignments: DataFrame) -> DataFrame:  # C8
    """One row: entities, inconsistent ones, and the most values of one entity."""
    return gluing.consistency(assignments).agg(F.count("*").alias("n_entities"), F.count_if(F.col("n_values") > 1).alias("n_inconsistent"), F.coalesce(F.max("n_values"), F.lit(0)).alias("max_values"))


def global_section(assignments: DataFrame) -> DataFrame:  # C9
    return gluing.global_assignment(assignments)


def mixed(facts: DataFrame, derivations: DataFrame, seeds: DataFrame, start: str, end: str, radius: int = 1) -> DataFrame:  # C10
    """(step, n): neighbourhood, its overlap with the interval, the overlap's provenance, and entities in conflict."""
    near = graph.fact_neighborhood(touches(facts), seeds, radius).select("fact_id").distinct()
    local = facts.join(near, "fact_id", "left_semi")
    timed = joins.overlaps_with(local, start, end)
    chain = graph.chain(derivations, timed.select(F.col("fact_id").alias("start")).distinct())
    clash = gluing.consistency(timed.select(F.col("subject").alias("entity"), F.col("relation").alias("value"))).where("n_values > 1")
    out = None
    for name, df in (("neighborhood", near), ("interval", timed), ("provenance", chain), ("conflicts", clash)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")
        out = one if out is None else out.unionByName(one)
    return out
