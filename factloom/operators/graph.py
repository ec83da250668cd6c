"""Walks, neighbourhoods, paths and lineage: joins per level, each level written before the next."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import Levels, cut
from factloom.operators import doubling
from factloom.operators.hubs import NODE_EDGES, Spread

#: Levels that are chained in one plan before it is cut.
CHAIN = 2
#: Levels of a lineage between two written tables.
HOPS = 4


def walk(edges: DataFrame, seeds: DataFrame, relation: str | None, depth: int, most: int = NODE_EDGES) -> DataFrame:
    """(node, depth) reachable from ``seeds`` (column ``node``) along ``relation`` in at most ``depth`` steps, shortest first.

    A node of more than ``most`` edges is followed by several tasks.
    """
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    e = Spread(e.select("src", "dst").distinct(), "src", most)
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for level in range(1, depth + 1):
        step = e.join(front.select(F.col("node").alias("src"))).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level))
        if level % CHAIN == 0 and level < depth:
            front = cut(front, "walk")
            if front.isEmpty():
                break
        seen = seen.union(front)
    return seen


def walked_facts(edges: DataFrame, seeds: DataFrame, relation: str | None, depth: int) -> DataFrame:
    """Facts whose edges the walk follows: those that leave a node met before the last step."""
    met = walk(edges, seeds, relation, depth - 1).select(F.col("node").alias("src"))
    e = edges if relation is None else edges.where(F.col("relation") == relation)
    return e.join(met, "src", "left_semi").select("fact_id").distinct()


def fact_neighborhood(touch: DataFrame, seeds: DataFrame, radius: int, most: int = NODE_EDGES) -> DataFrame:
    """(seed, fact_id, distance): per seed fact, facts that share an entity with the frontier; the frontier is replaced each hop.

    ``touch`` is (fact_id, entity), ``seeds`` has column ``seed``.  An entity of
    more than ``most`` facts is met by several tasks.
    """
    around_entity = Spread(touch.select("entity", "fact_id"), "entity", most)
    seen = seeds.select("seed", F.col("seed").alias("fact_id"), F.lit(0).alias("distance"))
    front = seen
    for hop in range(1, radius + 1):
        around = front.join(touch, "fact_id").select("seed", "entity").distinct()
        step = around_entity.join(around).select("seed", "fact_id").distinct()
        front = step.join(seen.select("seed", "fact_id"), ["seed", "fact_id"], "left_anti").withColumn("distance", F.lit(hop))
        if hop % CHAIN == 0 and hop < radius:
            front = cut(front, "around")
        seen = seen.union(front)
    return seen


def neighborhood_sizes(touch: DataFrame, seeds: DataFrame, most: int = NODE_EDGES) -> DataFrame:
    """(seed, n): how many facts share an entity with each seed fact, itself among them.

    Facts of entities of more than ``most`` facts are counted once for all seeds
    that have the same such entities; what a seed meets by others is counted on
    its own, where none of those entities has it.  So no seed meets a hub's facts one by one.
    """
    touch = touch.select("fact_id", "entity").where("entity is not null")
    seeds = seeds.select("seed").distinct()
    hubs = cut(touch.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") > most).select("entity"), "hubs")
    own = cut(touch.join(seeds, F.col("fact_id") == F.col("seed")).select("seed", "entity").distinct(), "own")
    above = cut(own.join(hubs, "entity", "left_semi").groupBy("seed").agg(F.array_sort(F.collect_set("entity")).alias("hubs")), "above")
    shared = above.select("hubs").distinct().select("hubs", F.explode("hubs").alias("entity")).join(touch, "entity").select("hubs", "fact_id").distinct().groupBy("hubs").agg(F.count("*").alias("common"))
    near = cut(own.join(hubs, "entity", "left_anti").join(touch, "entity").select("seed", "fact_id").distinct(), "near")
    under = near.join(touch, "fact_id").join(above, "seed").where("array_contains(hubs, entity)").select("seed", "fact_id")
    alone = near.join(under, ["seed", "fact_id"], "left_anti").groupBy("seed").agg(F.count("*").alias("alone"))
    met = seeds.join(above.join(shared, "hubs"), "seed", "left").join(alone, "seed", "left")
    return met.select("seed", F.greatest(F.lit(1), F.coalesce("common", F.lit(0)) + F.coalesce("alone", F.lit(0))).cast("long").alias("n"))


def paths(edges: DataFrame, source: str, target: str | None, length: int) -> DataFrame:
    """(path, hops) from ``source`` to ``target`` (or anywhere) of at most ``length`` steps without a node twice."""
    e = edges.select("src", "dst").distinct()
    now = e.where(F.col("src") == source).where("src <> dst").select("dst", F.array("src", "dst").alias("path"))
    out = now
    for _ in range(1, length):
        now = now.where(F.col("dst") != target) if target is not None else now
        now = now.withColumnRenamed("dst", "src").join(e, "src").where("not array_contains(path, dst)").select("dst", F.concat("path", F.array("dst")).alias("path"))
        out = out.union(now)
    if target is not None:
        out = out.where(F.col("dst") == target)
    return out.select("path", (F.size("path") - 1).alias("hops"))


def chain(derivations: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, step, node): first parents followed until there is none, or a node comes again.

    ``derivations`` is (child, parent, pos), ``start`` has column ``start``.  Nothing is left
    out: a chain of more than ``limit`` steps raises, where one is given.
    """
    found = doubling.chains(derivations, start)
    if limit is not None and not found.where(F.col("step") > limit).isEmpty():
        raise ValueError(f"a chain goes on after {limit} steps")
    return found


def lineage(derivations: DataFrame, start: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, node, depth): all ancestors with their least depth; cycles end by what has been seen.

    Nothing is left out: ancestors beyond ``limit`` levels raise, where one is given.
    """
    e = derivations.select("child", "parent").distinct()
    levels = Levels(start.sparkSession, "lineage")
    front = levels.add(start.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    for level in count(HOPS, HOPS):
        met, step = None, front.select("start", "node")
        for depth in range(level - HOPS + 1, level + 1):
            step = step.join(e, step["node"] == e["child"]).select("start", F.col("parent").alias("node")).distinct()
            here = step.withColumn("depth", F.lit(depth))
            met = here if met is None else met.union(here)
        new = met.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        front = levels.add(new.join(levels.all().select("start", "node"), ["start", "node"], "left_anti")).where(F.col("depth") == level)
        if front.isEmpty():
            return levels.all()
        if limit is not None and level > limit:
            raise ValueError(f"ancestors go on after {limit} levels")


def reachable(edges: DataFrame, sources: DataFrame, targets: DataFrame, most: int = NODE_EDGES) -> DataFrame:
    """(source, target): all pairs of which the target can be reached from the source; a node reaches itself.

    ``sources`` has column ``source``, ``targets`` column ``target``.  Pairs grow
    backwards from the targets, along edges that a source reaches, so no pair
    is made twice and none that no source needs; it ends when a round finds none.
    """
    e = cut(edges.where("src <> dst").select("src", "dst").distinct(), "reach")
    alive = cut(sources.select(F.col("source").alias("node")).distinct(), "reach")
    forward, seen = Spread(e, "src", most), Levels(edges.sparkSession, "reach")
    front = seen.add(alive)
    while not front.isEmpty():
        step = forward.join(front.select(F.col("node").alias("src"))).select(F.col("dst").alias("node")).distinct()
        front = seen.add(step.join(seen.all(), "node", "left_anti"))
    met = cut(seen.all(), "reach")
    back = Spread(e.join(met.withColumnRenamed("node", "src"), "src", "left_semi"), "dst", most)
    pairs = Levels(edges.sparkSession, "pairs")
    front = pairs.add(targets.select(F.col("target").alias("node"), "target").distinct().join(met, "node", "left_semi"))
    while not front.isEmpty():
        step = back.join(front.withColumnRenamed("node", "dst")).select(F.col("src").alias("node"), "target").distinct()
        front = pairs.add(step.join(pairs.all(), ["node", "target"], "left_anti"))
    return pairs.all().join(alive, "node", "left_semi").select(F.col("node").alias("source"), "target")


def reaches(edges: DataFrame, source: str, target: str) -> bool:
    """Whether ``target`` can be reached; a node reaches itself."""
    spark = edges.sparkSession
    one = lambda name, node: spark.createDataFrame([(node,)], f"{name} string")
    return not reachable(edges, one("source", source), one("target", target)).isEmpty()
