"""Joins with edge tables in which a few nodes have most edges: their edges are dealt to several tasks by a salt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut

#: Edges of one node that a task joins.
NODE_EDGES = 1_000_000


class Spread:
    """Edges by ``key``, those of hubs salted; ``hubs`` is (key, ways), a row for every ``most`` edges at most."""

    def __init__(self, edges: DataFrame, key: str, most: int = NODE_EDGES):
        self.key = key
        degrees = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
        self.hubs = cut(degrees.select(key, F.ceil(F.col("n") / most).cast("int").alias("ways")), "hubs")
        if self.hubs.isEmpty():
            self.hubs, self.edges = None, edges
        else:
            rest = [c for c in edges.columns if c != key]
            salt = F.pmod(F.xxhash64(*rest), F.coalesce("ways", F.lit(1))).cast("int")
            self.edges = cut(edges.join(self.hubs, key, "left").withColumn("salt", salt).drop("ways"), "spread")

    def join(self, front: DataFrame) -> DataFrame:
        """``front`` with all edges of its ``key``; a hub's row goes to each of its tasks."""
        if self.hubs is None:
            return front.join(self.edges, self.key)
        ways = front.join(self.hubs, self.key, "left")
        ways = ways.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
        return ways.join(self.edges, [self.key, "salt"]).drop("salt")
