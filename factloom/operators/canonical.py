"""The canonical layer: dimension tables of entities and relations, and facts described by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import sets


def entities(facts: DataFrame) -> DataFrame:
    """(entity, kind, n_facts): subjects and references with the kind before the slash, ``UNKNOWN`` without one."""
    refs = F.transform(F.filter("objects", lambda v: v["kind"] == "ref"), lambda v: v["ref"])
    names = facts.select("fact_id", F.explode(F.array_distinct(F.concat(F.array("subject"), refs))).alias("entity"))
    kind = F.when(F.instr("entity", "/") > 0, F.substring_index("entity", "/", 1)).otherwise("UNKNOWN")
    return names.groupBy("entity").agg(F.count("*").alias("n_facts")).select("entity", kind.alias("kind"), "n_facts")


def signature(objects: Column) -> Column:
    """Slot kinds in order, the type signature of a relation's facts."""
    return F.array_join(F.transform(objects, lambda v: v["kind"]), ",")


def relations(facts: DataFrame) -> DataFrame:
    """(relation, arity, slots, n_facts): one row for each signature a relation is used with."""
    return facts.groupBy("relation", F.size("objects").alias("arity"), signature(F.col("objects")).alias("slots")).agg(F.count("*").alias("n_facts"))


def described(facts: DataFrame, known_entities: DataFrame, known_relations: DataFrame) -> DataFrame:
    """(fact_id, subject, subject_kind, relation, arity, conforms): facts joined to the model.

    An unknown subject has kind ``UNKNOWN``; an unknown relation conforms, as
    nothing is said about it.
    """
    e = known_entities.select(F.col("entity").alias("subject"), F.col("kind").alias("subject_kind"))
    r = known_relations.groupBy("relation").agg(F.collect_set("slots").alias("allowed"))
    f = facts.select("fact_id", "subject", "relation", F.size("objects").alias("arity"), signature(F.col("objects")).alias("slots"))
    out = f.join(e, "subject", "left").join(r, "relation", "left")
    return out.select("fact_id", "subject", F.coalesce("subject_kind", F.lit("UNKNOWN")).alias("subject_kind"), "relation", "arity", (F.col("allowed").isNull() | F.array_contains("allowed", F.col("slots"))).alias("conforms"))


def equal_models(a: DataFrame, b: DataFrame) -> bool:
    """Whether two fact tables describe the same entities, relations and facts, metadata and order of writing aside."""
    content = lambda f: f.select("fact_id", "subject", "relation", F.transform("objects", V.canonical).alias("objects"), "attributes", "context", "confidence", "valid_start", "valid_end")
    pairs = [(entities(a), entities(b)), (relations(a), relations(b)), (content(a), content(b))]
    return all(sets.equivalent(x, y) for x, y in pairs)
