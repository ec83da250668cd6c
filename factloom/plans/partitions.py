"""Partition columns of stored facts, and what a query may skip by them.

Facts lie by the part of their context's root, by how long they hold and by
the year they start in.  A filter on these never loses a row that the query's
own predicate keeps: it is read off the same bounds, and an interval that ends
later than its class allows is of the class that is never skipped.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts
from factloom.functions.temporal import bounds
from factloom.operators.access import Kind, Query

#: Parts that context roots are dealt to: folders stay few however many roots there are.
ROOT_PARTS = 32
#: Most years from start to end of the two bounded classes; class 2 is longer or open.
SPANS = (1, 8)
COLUMNS = ("root_part", "span", "start_year")
SCHEMA = "root_part int, span int, start_year int"


def root(context: Column) -> Column:
    """The first segment that is not ``world``: what all contexts under a common one below ``world`` share."""
    parts = contexts.segments(context)
    return F.when((F.size(parts) > 1) & (parts[0] == contexts.WORLD), parts[1]).otherwise(parts[0])


def _part(context: Column) -> Column:
    return F.pmod(F.xxhash64(root(context)), F.lit(ROOT_PARTS)).cast("int")


def with_columns(facts: DataFrame) -> DataFrame:
    years = F.year("valid_end") - F.year("valid_start")
    span = F.when(years <= SPANS[0], 0).when(years <= SPANS[1], 1).otherwise(2)
    return facts.withColumns({"root_part": _part(F.col("context")), "span": span, "start_year": F.year("valid_start")})


def under(context: str) -> Column:
    """Partitions that can hold facts at ``context`` or below."""
    return F.lit(True) if context == contexts.WORLD else F.col("root_part") == _part(F.lit(context))


def during(lo: datetime | None, hi: datetime | None) -> Column:
    """Partitions that can hold facts that meet [lo, hi)."""
    year, span = F.col("start_year"), F.col("span")
    keep = year.isNotNull()
    if hi is not None:
        keep &= year <= ((hi - timedelta(microseconds=1)).year if hi > datetime.min else hi.year)
    if lo is not None:
        keep &= (span == 2) | ((span == 0) & (year >= lo.year - SPANS[0])) | ((span == 1) & (year >= lo.year - SPANS[1]))
    return keep


def pruning(q: Query) -> Column:
    """The partitions that ``q`` has to read."""
    keep = under(q.context)
    if q.kind is Kind.TEMPORAL or q.start is not None or q.end is not None:
        keep &= during(*bounds(q.start, q.end))
    return keep
