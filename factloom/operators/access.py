"""Typed queries over facts: every non-null field of a query is one predicate, all of them ANDed."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts
from factloom.functions import values as V


class Kind(str, Enum):
    LOOKUP = "lookup"
    PATH = "path"
    CONTEXT = "context"
    TEMPORAL = "temporal"
    AGGREGATION = "aggregation"
    MIXED = "mixed"
    PROVENANCE = "provenance"
    NEIGHBORHOOD = "neighborhood"
    CONSISTENCY = "consistency"
    GLOBAL = "global"


@dataclass(frozen=True)
class Query:
    kind: Kind
    subject: str | None = None
    relation: str | None = None
    objects: tuple[str, ...] = ()
    context: str = contexts.WORLD
    start: str | None = None
    end: str | None = None
    source: str | None = None
    method: str | None = None
    min_confidence: float | None = None
    limit: int | None = None
    offset: int = 0


def by_subject(facts: DataFrame, subject: str) -> DataFrame:
    return facts.where(F.col("subject") == subject)


def by_relation(facts: DataFrame, relation: str) -> DataFrame:
    return facts.where(F.col("relation") == relation)


def by_object(facts: DataFrame, entity: str) -> DataFrame:
    return facts.where(V.mentions(F.col("objects"), F.lit(entity)))


def in_context(facts: DataFrame, context: str) -> DataFrame:
    """Facts exactly at ``context``."""
    return facts.where(F.col("context") == context)


def context_descendants(facts: DataFrame, context: str) -> DataFrame:
    """Facts at ``context`` or below; ``world`` is everything."""
    return facts.where(contexts.under(F.col("context"), context))


def context_visible_from(facts: DataFrame, context: str) -> DataFrame:
    """Facts at ``context`` or above, restricted down to it."""
    return facts.where(contexts.visible_from(F.col("context"), context)).withColumn("context", F.lit(context))


def temporal(facts: DataFrame, start: str | None = None, end: str | None = None, whole_year: bool = True) -> DataFrame:
    """Facts whose interval meets the bounds; without bounds, all that have a start."""
    from factloom.functions.temporal import bounds, overlaps

    lo, hi = bounds(start, end, whole_year)
    return facts.where(overlaps(F.col("valid_start"), F.col("valid_end"), lo, hi))


def neighborhood(facts: DataFrame, entity: str, subject_only: bool = False) -> DataFrame:
    """Facts whose subject is ``entity`` or, unless ``subject_only``, that refer to it."""
    hit: Column = F.col("subject") == entity
    return facts.where(hit if subject_only else hit | V.mentions(F.col("objects"), F.lit(entity)))


def by_provenance(facts: DataFrame, source: str | None = None, method: str | None = None) -> DataFrame:
    if source is not None:
        facts = facts.where(F.col("provenance.source") == source)
    if method is not None:
        facts = facts.where(F.col("provenance.method") == method)
    return facts


def page(facts: DataFrame, limit: int | None, offset: int = 0, key: str = "fact_id") -> DataFrame:
    """A page in the order of ``key``; no limit is unlimited, 0 is empty."""
    if limit is None and not offset:
        return facts
    facts = facts.orderBy(key)
    if offset:
        facts = facts.offset(offset)
    return facts if limit is None else facts.limit(limit)


def predicate(q: Query) -> Column:
    """The row predicate of a typed query."""
    from factloom.functions.temporal import bounds, overlaps

    c = F.lit(True)
    if q.subject is not None:
        if q.kind is Kind.NEIGHBORHOOD:
            c &= (F.col("subject") == q.subject) | V.mentions(F.col("objects"), F.lit(q.subject))
        else:
            c &= F.col("subject") == q.subject
    if q.relation is not None:
        c &= F.col("relation") == q.relation
    for o in q.objects:
        c &= V.mentions(F.col("objects"), F.lit(o))
    if q.context != contexts.WORLD:
        c &= contexts.under(F.col("context"), q.context)
    if q.kind is Kind.TEMPORAL or q.start is not None or q.end is not None:
        c &= overlaps(F.col("valid_start"), F.col("valid_end"), *bounds(q.start, q.end))
    if q.source is not None:
        c &= F.col("provenance.source") == q.source
    if q.method is not None:
        c &= F.col("provenance.method") == q.method
    if q.min_confidence is not None:
        c &= F.col("confidence") >= q.min_confidence
    return c


def run(facts: DataFrame, q: Query) -> DataFrame:
    return page(facts.where(predicate(q)), q.limit, q.offset)


def current(facts: DataFrame) -> DataFrame:
    """The last version of each fact by ``seq``: one aggregate, no window over a key's versions."""
    whole = F.struct("seq", *(c for c in facts.columns if c != "seq"))
    return facts.groupBy("fact_id").agg(F.max_by(whole, "seq").alias("f")).select("f.*").select(*facts.columns)
