"""Ancestors of all nodes, with the nodes that derive from each one held as runs of numbers.

Nodes are numbered in the order of their names, short ones first, as ids are
given out; what derives from a node then lies in a few runs [lo, hi), where
ids follow each other, and in one run a node where they do not.  A round goes a
level further, for all nodes at once: the runs that reached a node go on to its
parents, which keep what they have not seen.  A node that meets nothing new at
one level meets nothing at a later one (who is nearest by a path is nearer by
one step less), so its runs are dropped and what still reaches it is too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.staging import cut

#: Numbers of a run that are written out at once.
RUN = 10_000


def numbered(derivations: DataFrame) -> DataFrame:
    """(name, id, derived): all nodes by increasing numbers, and whether they are the child of a row."""
    ends = derivations.select(F.col("child").alias("name"), F.lit(True).alias("derived")).union(derivations.select("parent", F.lit(False))).where("name is not null")
    ends = ends.groupBy("name").agg(F.max("derived").alias("derived")).withColumn("size", F.length("name"))
    dealt = ends.repartitionByRange("size", "name").sortWithinPartitions("size", "name")
    return cut(dealt.select("name", F.monotonically_increasing_id().alias("id"), "derived"), "nodes")


def _bounds(runs: DataFrame, new: int) -> DataFrame:
    """(node, at, new, seen): one more run begins, or one fewer goes on, at each end."""
    at = lambda c, n: F.struct(F.col(c).alias("at"), F.lit(n * new).alias("new"), F.lit(n * (1 - new)).alias("seen"))
    return runs.select("node", F.explode(F.array(at("lo", 1), at("hi", -1))).alias("b")).select("node", "b.*")


def _met(runs: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, lo, hi, new): what ``runs`` add to ``seen``, and what was seen, of nodes to which they add something."""
    ends = _bounds(runs, 1).unionByName(_bounds(seen, 0)).groupBy("node", "at").agg(F.sum("new").alias("new"), F.sum("seen").alias("seen")).where("new <> 0 or seen <> 0")
    w = W.partitionBy("node").orderBy("at")
    over = ends.select("node", "at", F.sum("new").over(w).alias("new"), F.sum("seen").over(w).alias("seen"))
    kind = over.select("node", "at", F.when(F.col("seen") > 0, 2).when(F.col("new") > 0, 1).otherwise(0).alias("kind"))
    turns = kind.withColumn("before", F.lag("kind", 1, 0).over(w)).where("kind <> before")
    parts = turns.select("node", F.col("at").alias("lo"), F.lead("at").over(w).alias("hi"), "kind").where("kind > 0")
    # Nodes without a run that was seen are done.
    grows = F.min("kind").over(W.partitionBy("node")) < F.max("kind").over(W.partitionBy("node"))
    return parts.withColumn("grows", grows).where("grows").select("node", "lo", "hi", (F.col("kind") == 1).alias("new"))


def descendant_runs(derivations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, lo, hi, depth): what derives from each node, by the least number of steps from 1 on, as runs of ``numbered`` ids; cycles end by themselves."""
    known = nodes.select("name", "id")
    edge = derivations.where("child <> parent").select("child", "parent").distinct()
    edge = edge.join(known.toDF("child", "c"), "child").join(known.toDF("parent", "p"), "parent").select("c", "p")
    edge = cut(edge, "edges")
    itself = nodes.select(F.col("id").alias("node"), F.col("id").alias("lo"), (F.col("id") + 1).alias("hi"))
    level, depth = cut(_met(edge.select(F.col("p").alias("node"), F.col("c").alias("lo"), (F.col("c") + 1).alias("hi")), itself), "level"), 1
    out = level.where("new").select("node", "lo", "hi", F.lit(depth).alias("depth"))
    while not level.isEmpty():
        front = level.where("new").join(edge, F.col("node") == F.col("c")).select(F.col("p").alias("node"), "lo", "hi")
        level, depth = cut(_met(front, level), "level"), depth + 1
        out = out.union(level.where("new").select("node", "lo", "hi", F.lit(depth).alias("depth")))
    return out


def ancestors(derivations: DataFrame) -> DataFrame:
    """(start, node, depth): all ancestors of every node with their least depth, itself at 0; cycles end by themselves."""
    nodes = numbered(derivations)
    runs = descendant_runs(derivations, nodes).withColumn("from", F.explode(F.expr(f"sequence(lo, hi - 1, {RUN})")))
    pairs = runs.select("node", "depth", F.explode(F.expr(f"sequence(from, least(from + {RUN}, hi) - 1)")).alias("start"))
    named = pairs.join(nodes.select(F.col("id").alias("start"), F.col("name").alias("from")), "start").join(nodes.select(F.col("id").alias("node"), F.col("name").alias("to")), "node")
    return nodes.select(F.col("name").alias("start"), F.col("name").alias("node"), F.lit(0).alias("depth")).union(named.select("from", "to", "depth"))


def ancestor_totals(derivations: DataFrame) -> DataFrame:
    """(node, n, nearest, farthest, depths): how many children derive from a node, itself among them if it is one, and how far; no pair is written."""
    nodes = numbered(derivations)
    size = F.col("hi") - F.col("lo")
    met = descendant_runs(derivations, nodes).groupBy(F.col("node").alias("id")).agg(F.sum(size).alias("n"), F.min("depth").alias("nearest"), F.max("depth").alias("farthest"), F.sum(size * F.col("depth")).alias("depths"))
    own = F.col("derived").cast("long")
    both = nodes.join(met, "id", "left").where("derived or n is not null")
    return both.select(F.col("name").alias("node"), (F.coalesce("n", F.lit(0)) + own).alias("n"), F.when(F.col("derived"), 0).otherwise(F.col("nearest")).alias("nearest"), F.coalesce("farthest", F.lit(0)).alias("farthest"), F.coalesce("depths", F.lit(0)).cast("long").alias("depths"))
