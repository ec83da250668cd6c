"""Gluing partial facts into whole ones, and where they disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts as C
from factloom.functions import values as V


def _judged(sections: DataFrame) -> DataFrame:
    """One row per fact with at least two sections: what would be merged and what disagrees.

    Two aggregates: attributes by (fact, key), then everything by fact.  The
    second reads structs only, so a fact with many sections is combined on the
    map side before it moves.
    """
    canon = F.transform("objects", V.canonical)
    known = lambda field: F.when((F.col(f"provenance.{field}") != "unknown") & F.col(f"provenance.{field}").isNotNull(), F.struct("seq", F.col(f"provenance.{field}").alias("v")))
    whole = sections.groupBy("fact_id").agg(
        F.count("*").alias("n_sections"),
        F.count_distinct("subject").alias("n_subject"),
        F.count_distinct("relation").alias("n_relation"),
        F.count_distinct(F.when(F.size("objects") > 0, F.to_json(canon))).alias("n_objects"),
        F.min("subject").alias("subject"),
        F.min("relation").alias("relation"),
        F.max_by("objects", F.struct(F.size("objects") > 0, -F.col("seq"))).alias("objects"),
        F.max("confidence").alias("confidence"),
        F.max("provenance.confidence").alias("prov_confidence"),
        F.max("provenance.recorded_at").alias("prov_recorded_at"),
        F.max(known("source"))["v"].alias("prov_source"),
        F.max(known("method"))["v"].alias("prov_method"),
        F.max("valid_start").alias("valid_start"),
        F.min("valid_end").alias("valid_end"),
        F.max_by("metadata", "seq").alias("metadata"),
        F.max("seq").alias("seq"),
    )
    keys = sections.select("fact_id", F.explode("attributes").alias("a"))
    keys = keys.groupBy("fact_id", F.col("a.key").alias("key")).agg(F.count_distinct(F.to_json(V.canonical(F.col("a.value")))).alias("n"), F.min("a.value").alias("value"))
    attrs = keys.groupBy("fact_id").agg(F.sum((F.col("n") > 1).cast("long")).alias("n_clash"), F.array_sort(F.collect_list(F.struct("key", "value"))).alias("attributes"))
    return whole.where("n_sections >= 2").join(attrs, "fact_id", "left")


def _reason():
    return (
        F.when(F.col("n_subject") > 1, "subject")
        .when(F.col("n_relation") > 1, "relation")
        .when(F.col("n_objects") > 1, "objects")
        .when(F.coalesce(F.col("n_clash"), F.lit(0)) > 0, "attribute")
        .when(F.col("valid_start") >= F.col("valid_end"), "interval")
    )


def global_sections(sections: DataFrame) -> DataFrame:
    """Facts merged over all their sections: attributes united, confidences maximal, intervals intersected, at ``world``.

    Only facts with at least two sections that agree; the last known source and method by ``seq`` win.
    """
    m = _judged(sections).where(_reason().isNull())
    prov = F.struct(F.coalesce("prov_source", F.lit("unknown")).alias("source"), F.col("prov_recorded_at").alias("recorded_at"), F.col("prov_confidence").alias("confidence"), F.coalesce("prov_method", F.lit("unknown")).alias("method"))
    m = m.withColumn("provenance", prov).withColumn("context", F.lit(C.WORLD)).withColumn("attributes", F.coalesce("attributes", F.expr(V.NO_ATTRIBUTES)))
    return m.select(*(F.col(f.name).cast(f.dataType) for f in V.FACT.fields))


def conflicts(sections: DataFrame) -> DataFrame:
    """(fact_id, n_sections, reason) of facts whose sections do not glue."""
    return _judged(sections).select("fact_id", "n_sections", _reason().alias("reason")).where("reason is not null")


def glue_cover(sections: DataFrame, target: str) -> DataFrame:
    """Sections of a cover re-homed at ``target`` where all that are comparable agree; ``agrees`` is false elsewhere.

    Sections agree if those of one fact in comparable contexts have equal
    content.  Comparing each section with its fact's others at prefixes of its
    context is an equi-join.
    """
    content = F.sha2(F.to_json(F.struct("subject", "relation", "objects", "attributes")), 256)
    s = sections.select("fact_id", "context", "seq", content.alias("content"))
    below = s.select("fact_id", F.col("content").alias("mine"), F.explode(C.ancestors(F.col("context"))).alias("context"))
    bad = below.join(s.select("fact_id", "context", "content"), ["fact_id", "context"]).where("mine <> content").select("fact_id").distinct()
    first = sections.groupBy("fact_id").agg(F.min_by(F.struct(*sections.columns), "seq").alias("f")).select("f.*")
    return first.join(bad.withColumn("bad", F.lit(True)), "fact_id", "left").withColumn("context", F.lit(target)).withColumn("agrees", F.col("bad").isNull()).drop("bad")


def consistency(assignments: DataFrame) -> DataFrame:
    """(entity, n_values) over (context, entity, value): more than one value is a conflict."""
    return assignments.groupBy("entity").agg(F.count_distinct("value").alias("n_values"))


def global_assignment(assignments: DataFrame) -> DataFrame:
    """(entity, value) where all contexts agree."""
    return assignments.groupBy("entity").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).where("n = 1").select("entity", "value")


def at_root(sections: DataFrame) -> DataFrame:
    """Sections at the broadest context in use."""
    depth = C.depth(F.col("context"))
    top = sections.agg(F.min(F.struct(depth.alias("d"), F.col("context").alias("c"))).alias("t")).select(F.col("t.c").alias("context"))
    return sections.join(F.broadcast(top), "context", "left_semi")  # one row


def locally_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(fact_id, equal): the facts of both sides, compared after restriction to what their contexts share."""
    view = lambda d, p: d.select("fact_id", F.col("context").alias(f"{p}_context"), F.to_json(F.struct("subject", "relation", F.transform("objects", V.canonical).alias("o"), "attributes")).alias(f"{p}_content"))
    both = view(a, "a").join(view(b, "b"), "fact_id")
    shared = C.common_prefix(F.col("a_context"), F.col("b_context")).isNotNull()
    return both.select("fact_id", (shared & (F.col("a_content") == F.col("b_content"))).alias("equal"))
