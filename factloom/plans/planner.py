"""Choosing and explaining access paths on the driver; Catalyst plans what is chosen."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from factloom.operators.access import Kind, Query

#: Relative costs: reading a row, a bound column's share of rows, and putting a fact together again from triples.
ROW, BOUND, REBUILD = 1.0, 0.1, 4.0


@dataclass(frozen=True)
class Statistics:
    facts: int = 0
    triples: int = 0


@dataclass(frozen=True)
class Choice:
    path: str  # "facts" or "triples"
    scope: str  # "local", "semi-local" or "global"
    cost: float
    steps: tuple[str, ...]


def scope(q: Query) -> str:
    if q.kind in (Kind.LOOKUP, Kind.NEIGHBORHOOD) and q.subject is not None:
        return "local"
    if q.context != "world" or q.start or q.end or q.source or q.relation:
        return "semi-local"
    return "global"


def choose(q: Query, stats: Statistics) -> Choice:
    """Facts answer every query with one scan; triples cost their rows and the rebuilding of whole facts."""
    bound = sum(x is not None for x in (q.subject, q.relation, q.source, q.method)) + (q.context != "world") + len(q.objects)
    share = BOUND**bound
    facts = ROW * stats.facts
    triples = ROW * stats.triples + REBUILD * stats.facts * share
    path = "facts" if facts <= triples else "triples"
    steps = [f"scan {path}"]
    steps += [f"filter {n}" for n, v in (("subject", q.subject), ("relation", q.relation), ("source", q.source), ("method", q.method)) if v is not None]
    if q.context != "world":
        steps.append(f"filter context under {q.context}")
    if q.start or q.end:
        steps.append("filter interval")
    if path == "triples":
        steps.append("group triples into facts")
    if q.limit is not None or q.offset:
        steps.append("take a page by fact_id")
    return Choice(path, scope(q), min(facts, triples), tuple(steps))


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """Spark's plan as text."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


#: Session settings by name, for ablations; ``default`` is what the engine expects.
PROFILES: dict[str, dict[str, str]] = {
    "default": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"},
    "minimal": {"spark.sql.adaptive.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"},
    "research": {"spark.sql.adaptive.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"},
    "max": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true"},
    "memory": {"spark.sql.adaptive.enabled": "true", "spark.sql.files.maxPartitionBytes": "32m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"},
    "debug": {"spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false"},
}


class profile:
    """``with profile(spark, "minimal"): ...`` sets a profile and puts the session back afterwards."""

    def __init__(self, spark, name: str):
        self.spark, self.settings, self.before = spark, PROFILES[name], {}

    def __enter__(self):
        for k, v in self.settings.items():
            self.before[k] = self.spark.conf.get(k, None)
            self.spark.conf.set(k, v)
        return self.spark

    def __exit__(self, *exc):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


def ablate(spark, query, names: tuple[str, ...] = tuple(PROFILES), repeat: int = 1) -> dict[str, float]:
    """Seconds of ``query()`` (a DataFrame) under each profile, the least of ``repeat`` runs, written nowhere."""
    import time

    out = {}
    for name in names:
        with profile(spark, name):
            took = []
            for _ in range(repeat):
                began = time.perf_counter()
                query().write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - began)
        out[name] = min(took)
    return out
