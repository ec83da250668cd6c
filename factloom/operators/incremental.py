"""A topology that follows its facts: members, sizes and restriction edges, changed by what a write changes.

Sizes and the numbers of shared points are sums over facts, so a write adds
what its new versions have and takes off what the old ones had; only facts that
change are exploded.  Edges are read off the sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut
from factloom.operators import topology


def _held(points: DataFrame) -> DataFrame:
    """(kind, open_set) for each set of each fact."""
    return points.select(F.explode("sets").alias("o")).select("o.kind", "o.open_set")


def _pairs(points: DataFrame) -> DataFrame:
    """(source, target) for each two sets of each fact."""
    names = points.select(F.array_distinct(F.transform("sets", lambda o: o["open_set"])).alias("names"))
    rows = names.select("names", F.explode("names").alias("source")).select("source", F.explode("names").alias("target"))
    return rows.where("source <> target")


def _sum(base: DataFrame, change: DataFrame, by: list[str]) -> DataFrame:
    """Sums of ``n`` that are not 0; only keys that change are summed up again."""
    change = cut(change.groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0"), "change")
    old = base.join(change.select(*by), by, "left_semi")
    new = old.unionByName(change).groupBy(*by).agg(F.sum("n").alias("n")).where("n <> 0")
    return base.join(change.select(*by), by, "left_anti").unionByName(new)


@dataclass(frozen=True)
class Topology:
    """``points`` (fact_id, sets), ``sizes`` (kind, open_set, n) and ``shared`` (source, target, n), as written tables."""

    kinds: tuple[str, ...]
    points: DataFrame
    sizes: DataFrame
    shared: DataFrame

    @property
    def members(self) -> DataFrame:
        """(open_set, kind, fact_id)."""
        return self.points.select("fact_id", F.explode("sets").alias("o")).select("o.open_set", "o.kind", "fact_id")

    @classmethod
    def build(cls, facts: DataFrame, kinds: tuple[str, ...]) -> Topology:
        points = cut(topology.points(facts, kinds), "points")
        sizes = _held(points).groupBy("kind", "open_set").agg(F.count("*").alias("n"))
        shared = _pairs(points).groupBy("source", "target").agg(F.count("*").alias("n"))
        return cls(kinds, points, cut(sizes, "sizes"), cut(shared, "shared"))

    def changed(self, ids: DataFrame, after: DataFrame) -> Topology:
        """After a write that touches ``ids`` (column ``fact_id``): ``after`` is what these facts are now, nothing of those that are deleted."""
        ids = cut(ids.select("fact_id").distinct(), "ids")
        was = cut(self.points.join(ids, "fact_id", "left_semi"), "was")
        now = cut(topology.points(after.join(ids, "fact_id", "left_semi"), self.kinds), "now")
        points = self.points.join(ids, "fact_id", "left_anti").unionByName(now)
        signed = lambda rows, n: rows.withColumn("n", F.lit(n).cast("long"))
        sizes = _sum(self.sizes, signed(_held(now), 1).unionByName(signed(_held(was), -1)), ["kind", "open_set"])
        shared = _sum(self.shared, signed(_pairs(now), 1).unionByName(signed(_pairs(was), -1)), ["source", "target"])
        return Topology(self.kinds, cut(points, "points"), cut(sizes, "sizes"), cut(shared, "shared"))

    def edges(self) -> DataFrame:
        """(source, target): target is a part of source."""
        size = self.sizes.select(F.col("open_set").alias("target"), F.col("n").alias("points"))
        return self.shared.join(size, "target").where("n = points").select("source", "target")
