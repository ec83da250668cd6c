"""Chains of any number of starts, in as many rounds as the depth has binary digits.

Round k joins a table with itself to go twice as far.  A chain is then filled
in from the longest jump down: each row adds the one that lies 2^k steps
further, so that no row carries more than a start, a step and a node; down to
2^STRETCH steps, between which each row unfolds its node's own stretch, so that
most rows are neither shuffled nor written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut
from factloom.operators.ancestry import ancestors as ancestors

#: A node's own stretch has 2^STRETCH nodes.
STRETCH = 3
NO_NODES = "cast(array() as array<string>)"


def first_parents(derivations: DataFrame) -> DataFrame:
    """(node, to): the parent of the lowest position of each child that has one."""
    return derivations.groupBy("child").agg(F.min_by("parent", F.struct("pos", "parent")).alias("to")).where("to is not null").select(F.col("child").alias("node"), "to")


def _twice(jump: DataFrame) -> DataFrame:
    then = jump.select(F.col("node").alias("to"), F.col("to").alias("end"))
    return cut(jump.join(then, "to").select("node", F.col("end").alias("to")), "jump")


def jumps(parents: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables of 1, 2, 4 .. steps, and the nodes on cycles (``node``), if there are any.

    While a node has more than 2^k steps to go, one between 2^k and twice as
    many lies on its way; so where doubling loses no node, all that are left
    lead into cycles.  What they reach shrinks likewise until it is the cycles.
    """
    found, n = [cut(parents, "jump")], None
    left = found[0].count()
    while left:
        found.append(_twice(found[-1]))
        n, left = left, found[-1].count()
        if n == left:
            break
    if not left:
        return found, None
    met, size = found[-1].select(F.col("to").alias("node")).distinct(), None
    far = found[-1]
    while size != (now := met.count()):
        size, far = now, _twice(far)
        met = cut(far.select(F.col("to").alias("node")).distinct(), "cycle")
    return found, met


def _to_cycle(parents: DataFrame, cycles: DataFrame) -> DataFrame:
    """(node, len): how many different nodes a chain into a cycle has, its own first."""
    within = parents.join(cycles, "node", "left_semi")
    # The smallest node within 1, 2, 4 .. steps: where no window's changes, it is the cycle's.
    low = cut(within.select("node", "to", F.least("node", "to").alias("low")), "cycle")
    while True:
        then = low.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("low").alias("next"))
        more = cut(low.join(then, "to").select("node", F.col("end").alias("to"), F.least("low", "next").alias("low"), (F.col("next") < F.col("low")).alias("changed")), "cycle")
        low = more.drop("changed")
        if more.where("changed").isEmpty():
            break
    size = low.groupBy("low").agg(F.count("*").alias("size"))
    rounds = low.join(size, "low").select("node", "size")
    # Steps to the first node of a cycle, doubling over those that are on none.
    outside = parents.join(cycles, "node", "left_anti")
    way = cut(outside.select("node", "to", F.lit(1).cast("long").alias("steps")), "cycle")
    done = cut(cycles.select("node", F.col("node").alias("entry"), F.lit(0).cast("long").alias("steps")), "cycle")
    while True:
        ends = done.select(F.col("node").alias("to"), "entry", F.col("steps").alias("more"))
        new = way.join(ends, "to").select("node", "entry", (F.col("steps") + F.col("more")).alias("steps"))
        new = cut(new, "cycle")
        if new.isEmpty():
            break
        done = cut(done.unionByName(new), "cycle")
        rest = way.join(new.select("node"), "node", "left_anti")
        then = way.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("steps").alias("more"))
        way = cut(rest.join(then, "to").select("node", F.col("end").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "cycle")
    return done.join(rounds.withColumnRenamed("node", "entry"), "entry").select("node", (F.col("steps") + F.col("size")).alias("len"))


def _stretches(parents: DataFrame) -> DataFrame:
    """(node, way): the next 2^STRETCH nodes on each node's chain, fewer where it ends."""
    way = parents.select("node", F.array("to").alias("way"))
    for k in range(STRETCH):
        then = way.select(F.col("node").alias("last"), F.col("way").alias("then"))
        way = way.withColumn("last", F.when(F.size("way") == 1 << k, F.element_at("way", -1)))
        way = cut(way.join(then, "last", "left").select("node", F.concat("way", F.coalesce("then", F.expr(NO_NODES))).alias("way")), "way")
    return way


def chains(derivations: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(start, step, node): first parents followed until there is none, or a node comes again; of all nodes, or those of ``start``."""
    parents = cut(first_parents(derivations), "parents")
    found, cycles = jumps(parents)
    if start is None:
        start = parents.select(F.col("node").alias("start")).union(parents.select("to")).distinct()
    rows = start.select("start").distinct().select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("node"), F.lit(None).cast("long").alias("len"))
    if cycles is not None:
        length = cut(_to_cycle(parents, cycles), "cycle")
        most = length.agg(F.max("len")).first()[0]
        while 1 << len(found) < most:
            found.append(_twice(found[-1]))
        rows = rows.drop("len").join(length.withColumnRenamed("node", "start"), "start", "left").select("start", "step", "node", "len")
    for k in reversed(range(STRETCH, len(found))):
        step = 1 << k
        on = rows.where(F.col("len").isNull() | (F.col("step") + step < F.col("len"))).join(found[k], "node")
        rows = cut(rows.unionByName(on.select("start", (F.col("step") + step).alias("step"), F.col("to").alias("node"), "len")), "chain")
    on = rows.join(_stretches(found[0]), "node", "left")
    on = on.select("start", "step", "len", F.posexplode(F.concat(F.array("node"), F.coalesce(F.slice("way", 1, (1 << STRETCH) - 1), F.expr(NO_NODES)))).alias("more", "node"))
    on = on.where(F.col("len").isNull() | (F.col("step") + F.col("more") < F.col("len")))
    return on.select("start", (F.col("step") + F.col("more")).cast("int").alias("step"), "node")
