"""Which settings matter: one query with some of the optimisations switched off."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans.suite import seconds

#: Optimisations by name: the setting and its values when on and when off.
SWITCHES: dict[str, tuple[str, str, str]] = {
    "adaptive": ("spark.sql.adaptive.enabled", "true", "false"),
    "skew_join": ("spark.sql.adaptive.skewJoin.enabled", "true", "false"),
    "broadcast": ("spark.sql.autoBroadcastJoinThreshold", "10485760", "-1"),
    "codegen": ("spark.sql.codegen.wholeStage", "true", "false"),
    "pushdown": ("spark.sql.parquet.filterPushdown", "true", "false"),
    "bloom_filter": ("spark.sql.optimizer.runtime.bloomFilter.enabled", "true", "false"),
}


def plans(strategy: str, names: tuple[str, ...] = tuple(SWITCHES), subsets: int = 8, seed: int = 42) -> Iterator[tuple[str, ...]]:
    """Sets of optimisations to switch off: one each, every pair, or ``subsets`` drawn at random."""
    if strategy == "leave_one_out":
        yield from ((n,) for n in names)
    elif strategy == "pairwise":
        yield from combinations(names, 2)
    elif strategy == "random_subset":
        rng = random.Random(seed)
        for _ in range(subsets):
            yield tuple(sorted(rng.sample(names, rng.randint(1, len(names)))))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")


@dataclass
class Report:
    baseline: float
    runs: list[tuple[tuple[str, ...], float]] = field(default_factory=list)

    def worst_offenders(self, k: int = 5) -> list[tuple[tuple[str, ...], float]]:
        """What is slowest to be without."""
        return sorted(self.runs, key=lambda r: -r[1])[:k]

    def biggest_improvements(self, k: int = 5) -> list[tuple[tuple[str, ...], float]]:
        """What is fastest to be without."""
        return sorted(self.runs, key=lambda r: r[1])[:k]

    def speedups(self) -> dict[str, float]:
        """Seconds without each single optimisation over seconds with all."""
        return {off[0]: took / max(1e-9, self.baseline) for off, took in self.runs if len(off) == 1}


def study(spark: SparkSession, query: Callable[[], DataFrame], strategy: str = "leave_one_out", runs: int = 1, **options) -> Report:
    """Times ``query`` with everything on, then without each set of ``plans``; the session is then as before."""
    before = {key: spark.conf.get(key, None) for key, _, _ in SWITCHES.values()}

    def timed(off: tuple[str, ...]) -> float:
        for name, (key, on, without) in SWITCHES.items():
            spark.conf.set(key, without if name in off else on)
        return min(seconds(query, runs))

    try:
        out = Report(timed(()))
        for off in plans(strategy, **options):
            out.runs.append((off, timed(off)))
        return out
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
