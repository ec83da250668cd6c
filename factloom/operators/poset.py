"""The contexts in use as a partially ordered set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts as C


def contexts(facts: DataFrame, with_ancestors: bool = True) -> DataFrame:
    """(context, depth, parent) of all contexts in use and, if asked, everything above them."""
    names = facts.select(F.explode(C.ancestors(F.col("context"))).alias("context")) if with_ancestors else facts.select("context")
    c = F.col("context")
    return names.where("context is not null").distinct().select("context", C.depth(c).alias("depth"), C.parent(c).alias("parent"))


def cover(known: DataFrame) -> DataFrame:
    """(context, child): children with nothing in between among ``known`` contexts.

    Each context looks its nearest known ancestor up by name: an equi-join on
    its prefixes, not a comparison of all pairs.
    """
    above = known.select(F.col("context").alias("child"), F.posexplode(C.ancestors(F.col("context"))).alias("pos", "context")).where("context <> child")
    near = above.join(known.select("context"), "context", "left_semi")
    return near.groupBy("child").agg(F.max_by("context", "pos").alias("context")).select("context", "child")


def leaves(known: DataFrame) -> DataFrame:
    """Contexts with nothing below them."""
    inner = known.select(F.explode(C.ancestors(F.col("context"))).alias("above"), "context").where("above <> context").select(F.col("above").alias("context"))
    return known.join(inner, "context", "left_anti").select("context")


def root(known: DataFrame) -> DataFrame:
    """The broadest context, by depth and then by name."""
    return known.orderBy("depth", "context").limit(1).select("context")


def lattice(pairs: DataFrame) -> DataFrame:
    """Meets and joins of (a, b), as paths and in the poset."""
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", C.path_meet(a, b).alias("path_meet"), C.path_join(a, b).alias("path_join"), C.poset_meet(a, b).alias("poset_meet"), C.poset_join(a, b).alias("poset_join"))


def visible(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts visible from each target (column ``target``): those at it or above, re-homed there.

    Targets are exploded into their prefixes and meet the facts by equality.
    """
    at = targets.select("target", F.explode(C.ancestors(F.col("target"))).alias("context"))
    return facts.join(at, "context").withColumn("context", F.col("target")).drop("target")
