"""Engines by name over one set of facts, with counters, a cache of parsed texts and a cache of global sections."""

from __future__ import annotations

import time
from collections import Counter, OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut
from factloom.operators import access, gluing, topology, triples
from factloom.plans import sparql


class PlanCache:
    """Parsed texts, the last used ``size`` of them."""

    def __init__(self, parse: Callable[[str], object], size: int = 256):
        self._parse, self._size, self._held = parse, size, OrderedDict()
        self.hits = self.misses = 0

    def get(self, text: str):
        if text in self._held:
            self.hits += 1
        else:
            self.misses += 1
            self._held[text] = self._parse(text)
            if len(self._held) > self._size:
                self._held.popitem(last=False)
        self._held.move_to_end(text)
        return self._held[text]

    def clear(self) -> None:
        self._held.clear()


class Engine:
    """Typed queries on facts as they are."""

    name = "facts"

    def __init__(self, facts: DataFrame):
        self.facts = facts
        self.counters: Counter = Counter()
        self.plans = PlanCache(sparql.parse)
        self._sections: DataFrame | None = None

    def _source(self) -> DataFrame:
        return self.facts

    def _counted(self, kind: str, made: DataFrame, began: float) -> DataFrame:
        self.counters[kind] += 1
        self.counters["planning_ns"] += int((time.perf_counter() - began) * 1e9)
        return made

    def query(self, q: access.Query) -> DataFrame:
        return self._counted("queries", access.run(self._source(), q), time.perf_counter())

    def sparql(self, text: str, numbers: tuple[str, ...] = ()) -> DataFrame:
        began = time.perf_counter()
        return self._counted("patterns", sparql.run(triples.statements(self._source()), self.plans.get(text), numbers=numbers), began)

    def restrict(self, source: str, target: str) -> DataFrame:
        """Sections of one open set in another; ``counters`` has how often each pair was asked for."""
        began = time.perf_counter()
        self.counters[f"restrict {source} > {target}"] += 1
        return self._counted("restrictions", topology.restrict(topology.members(self._source()), self._source(), source, target), began)

    def global_sections(self) -> DataFrame:
        """Glued once and written; read again until ``invalidate``."""
        if self._sections is None:
            self.counters["sections glued"] += 1
            self._sections = cut(gluing.global_sections(self._source()), "sections")
        else:
            self.counters["sections read"] += 1
        return self._sections

    def invalidate(self) -> None:
        """Forget what was glued; after facts have changed."""
        self._sections = None
        self.counters["version"] += 1


class TripleEngine(Engine):
    """The same queries on facts put together again from their triples."""

    name = "triples"

    def __init__(self, facts: DataFrame):
        super().__init__(facts)
        self.triples = triples.reify(facts)

    def _source(self) -> DataFrame:
        return triples.reconstruct(self.triples)

    def frequency(self) -> DataFrame:
        return self.triples.groupBy("predicate").agg(F.count("*").alias("n"))


ENGINES: dict[str, type[Engine]] = {e.name: e for e in (Engine, TripleEngine)}


def register(kind: type[Engine]) -> type[Engine]:
    if kind.name in ENGINES:
        raise ValueError(f"{kind.name} is registered twice")
    ENGINES[kind.name] = kind
    return kind


def create(name: str, facts: DataFrame) -> Engine:
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; there are {', '.join(sorted(ENGINES))}")
    return ENGINES[name](facts)
