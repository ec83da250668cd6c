"""A measuring harness: query classes on facts and on facts rebuilt from triples, verified against each other."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import access, sets, triples
from factloom.operators.access import Kind, Query

#: The query classes that are measured; the anchors exist in generated facts.
CLASSES = {
    "lookup": Query(Kind.LOOKUP, subject="entity_0"),
    "global": Query(Kind.GLOBAL),
    "temporal_bounded": Query(Kind.TEMPORAL, start="2022", end="2023"),
    "temporal_from": Query(Kind.TEMPORAL, start="2023"),
    "neighborhood": Query(Kind.NEIGHBORHOOD, subject="entity_1"),
    "context": Query(Kind.CONTEXT, context="ctx.0"),
}


def seconds(make: Callable[[], DataFrame], runs: int = 3, warm: int = 1) -> list[float]:
    """Seconds of each run, every row computed and written nowhere."""
    out = []
    for k in range(warm + runs):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        if k >= warm:
            out.append(time.perf_counter() - began)
    return out


def agree(facts: DataFrame, rebuilt: DataFrame, q: Query) -> bool:
    """Whether both representations give the same set of fact ids."""
    return sets.equivalent(access.run(facts, q).select("fact_id"), access.run(rebuilt, q).select("fact_id"))


def measure(spark: SparkSession, facts: DataFrame, runs: int = 3) -> DataFrame:
    """(class, path, mean_seconds, agrees)."""
    rebuilt = triples.reconstruct(triples.reify(facts))
    rows = []
    for name, q in CLASSES.items():
        same = agree(facts, rebuilt, q)
        for path, df in (("facts", facts), ("triples", rebuilt)):
            took = seconds(lambda df=df, q=q: access.run(df, q), runs)
            rows.append((name, path, sum(took) / len(took), same))
    return spark.createDataFrame(rows, "class string, path string, mean_seconds double, agrees boolean")


def scaling(spark: SparkSession, make: Callable[[int], DataFrame], sizes: Iterable[int], query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n, seconds, seconds_per_million) of one query over facts of several sizes."""
    rows = []
    for n in sizes:
        df = make(n)
        took = min(seconds(lambda: query(df), 2))
        rows.append((n, took, took / n * 1e6))
    return spark.createDataFrame(rows, "n long, seconds double, seconds_per_million double")


def sensitivity(spark: SparkSession, key: str, values: Iterable[str], query: Callable[[], DataFrame]) -> DataFrame:
    """(value, seconds) of one query under several values of one Spark setting, which is put back afterwards."""
    before, rows = spark.conf.get(key, None), []
    try:
        for v in values:
            spark.conf.set(key, v)
            rows.append((str(v), min(seconds(query, 2))))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.createDataFrame(rows, "value string, seconds double")
