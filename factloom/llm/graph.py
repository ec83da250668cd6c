"""Connected components of an edge table, by table operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.work import Workspace


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the
    pointer once more, and replaces the ends of all edges by what they point
    at.  Equal edges fall together and edges within one node vanish, so a
    group shrinks by half at least each round; the smallest node of a
    component always points at itself, so it is what remains.  Each round's
    tables are written; the rounds end when no edge is left.
    """
    now = ws.table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0", edges.count())
    n = now.count()
    labels, turn = None, 0
    while labels is None or n:
        turn += 1
        near = now.select("a", "b").union(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        first = near.select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        ends = first.select(F.col("node").alias("to"), F.col("to").alias("end"))
        points = ws.table(first.join(ends, "to").select("node", F.col("end").alias("to")), f"{name}-points-{turn}", 2 * n)
        if labels is None:
            labels, nodes = points.withColumnRenamed("to", "label"), 2 * n
        else:
            then = points.select(F.col("node").alias("label"), F.col("to").alias("then"))
            labels = ws.table(labels.join(then, "label", "left").select("node", F.coalesce("then", "label").alias("label")), f"{name}-labels-{turn}", nodes)
        a, b = points.select(F.col("node").alias("a"), F.col("to").alias("x")), points.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = now.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        now = ws.table(moved, f"{name}-edges-{turn}", n)
        ws.drop(f"{name}-edges-{turn - 1}")
        n = now.count()
    return labels
