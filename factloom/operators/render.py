"""Small graphs as Graphviz text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph

#: Edges of a drawing; more are refused rather than left out.
MOST = 2000


def _quoted(x) -> str:
    return '"' + str(x).replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(edges: DataFrame, source: str = "src", target: str = "dst", label: str | None = "relation", most: int = MOST) -> str:
    cols = [source, target] + ([label] if label else [])
    rows = edges.select(*cols).distinct().orderBy(*cols).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; narrow the graph first")
    lines = [f"  {_quoted(r[0])} -> {_quoted(r[1])}" + (f" [label={_quoted(r[2])}]" if label else "") + ";" for r in rows]
    return "\n".join(["digraph facts {", *lines, "}"])


def neighborhood(edges: DataFrame, node: str, depth: int = 1) -> str:
    """What can be reached from ``node`` in ``depth`` steps."""
    seeds = edges.sparkSession.createDataFrame([(node,)], "node string")
    met = graph.walk(edges, seeds, None, depth - 1).select(F.col("node").alias("src"))
    return dot(edges.join(met, "src", "left_semi"))


def topology(restriction_edges: DataFrame) -> str:
    return dot(restriction_edges, "source", "target", None)


def event(triples: DataFrame, event_id: str) -> str:
    """One reified fact: its event with each predicate and value."""
    v = F.coalesce("value.ref", "value.str", F.col("value.lng").cast("string"), F.col("value.dbl").cast("string"), F.col("value.bool").cast("string"), F.lit("null"))
    return dot(triples.where(F.col("event_id") == event_id).select(F.col("event_id").alias("src"), v.alias("dst"), F.col("predicate").alias("relation")))
