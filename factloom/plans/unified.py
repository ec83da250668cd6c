"""One entry for the four pattern queries: FACT, WALK, JOIN and GLUE."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import access, gluing, graph, joins, triples
from factloom.operators.access import Kind, Query


class Form(str, Enum):
    FACT = "fact"
    WALK = "walk"
    JOIN = "join"
    GLUE = "glue"


@dataclass(frozen=True)
class Ask:
    """What is asked; a field that its form does not use has to be left alone.

    FACT: ``subject``, ``relation``, ``objects``, ``context``, ``min_confidence``.
    WALK: from ``entities`` along ``relation`` (any, without one) in ``depth`` steps.
    JOIN: facts of ``relation`` from and to ``entities``.
    GLUE: sections at or below ``context``, put together there.
    """

    form: Form
    subject: str | None = None
    relation: str | None = None
    objects: tuple[str, ...] = ()
    context: str = "world"
    min_confidence: float | None = None
    entities: tuple[str, ...] = ()
    depth: int = 0


#: What each form reads, and what it cannot do without.
_USES = {
    Form.FACT: ({"subject", "relation", "objects", "context", "min_confidence"}, set()),
    Form.WALK: ({"relation", "entities", "depth"}, {"entities", "depth"}),
    Form.JOIN: ({"relation", "entities"}, {"relation", "entities"}),
    Form.GLUE: ({"context"}, set()),
}


def ask(facts: DataFrame, a: Ask) -> DataFrame:
    """The facts that answer; GLUE adds ``agrees``."""
    uses, needs = _USES[a.form]
    given = {f for f in Ask.__dataclass_fields__ if f != "form" and getattr(a, f) != Ask.__dataclass_fields__[f].default}
    if given - uses or needs - given:
        raise ValueError(f"{a.form.value} takes {sorted(uses)} and needs {sorted(needs)}, not {sorted(given)}")
    if a.form is Form.FACT:
        return access.run(facts, Query(Kind.LOOKUP, a.subject, a.relation, a.objects, a.context, min_confidence=a.min_confidence))
    if a.form is Form.GLUE:
        return gluing.glue_cover(access.context_descendants(facts, a.context), a.context)
    spark = facts.sparkSession
    entities = spark.createDataFrame([(e,) for e in a.entities], "entity string")
    if a.form is Form.WALK:
        met = graph.walked_facts(triples.edges(facts), entities.select(F.col("entity").alias("node")), a.relation, a.depth)
    else:
        met = joins.entity_pairs(triples.edges(facts), entities, a.relation).select("fact_id").distinct()
    return facts.join(met, "fact_id", "left_semi")
