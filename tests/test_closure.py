"""The closure under intersection against brute force, in one go and by rounds."""

from __future__ import annotations

import random

import pytest

from factloom.operators import closure

SHAPE = "open_set string, fact_id string"


def brute(sets):
    closed = {frozenset(x) for x in sets.values()}
    while more := {a & b for a in closed for b in closed} - closed - {frozenset()}:
        closed |= more
    return closed


def got(spark, rows, limit):
    out = {}
    for r in closure.closed_members(spark.createDataFrame(rows, SHAPE), limit).collect():
        assert r.fact_id not in out.setdefault(r.open_set, set())
        out[r.open_set].add(r.fact_id)
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limit", [3, 20_000])
def test_closure(spark, seed, limit):
    rng = random.Random(seed)
    sets = {f"s{k}": {f"f{i}" for i in range(30) if rng.random() < p} for k, p in enumerate([0.2, 0.2, 0.4, 0.4, 0.6, 0.8, 0.9, 0.05])}
    sets |= {"all": {f"f{i}" for i in range(30)}, "twin": set(sets["s2"]), "below": {x for x in sets["s3"] if x != "f1"}, "lone": {"f3"}} if seed else {}
    sets = {k: v for k, v in sets.items() if v}
    found = got(spark, [(s, f) for s, fs in sets.items() for f in fs] * 2, limit)
    assert len({frozenset(x) for x in found.values()}) == len(found)
    assert {frozenset(x) for x in found.values()} == brute(sets)
    for name, points in found.items():
        same = sorted(s for s in sets if sets[s] == points)
        if same and len(points) > 1:
            assert name == same[0]
        assert points == set.intersection(*(sets[x] for x in name.split("&")))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("limit", [1, 3, 9, 20_000])
def test_sizes_alone(spark, seed, limit):
    """As many sets of each size as there are, though none is written: none but counts come out of a prefix."""
    rng = random.Random(seed)
    sets = {f"s{k}": {f"f{i}" for i in range(24) if rng.random() < p} for k, p in enumerate([0.15, 0.2, 0.3, 0.5, 0.7, 0.9])}
    sets |= {"all": {f"f{i}" for i in range(24)}, "twin": set(sets["s3"]), "lone": {"f3"}, "lone too": {"f3"}} if seed else {}
    sets = {k: v for k, v in sets.items() if v}
    facts = sorted(set().union(*sets.values()))
    rows = [(f, [s for s in sets if f in sets[s]]) for f in facts]
    got = {r.n_facts: r.n_sets for r in closure.closed_sizes(spark.createDataFrame(rows, "fact_id string, sets array<string>"), limit).collect()}
    want: dict = {}
    for x in brute(sets):
        want[len(x)] = want.get(len(x), 0) + 1
    assert got == want


def test_more_than_ten_thousand_sets(spark):
    # Of 14 sets that each leave out one of 14 points, all intersections but the empty one are different.
    points = [f"p{k}" for k in range(14)]
    rows = [(f"without {p}", q) for p in points for q in points if p != q]
    assert closure.closed_members(spark.createDataFrame(rows, SHAPE)).select("open_set").distinct().count() == 2**14 - 2


def test_empty(spark):
    assert closure.closed_members(spark.createDataFrame([], SHAPE)).isEmpty()
    assert closure.closed_sizes(spark.createDataFrame([], "sets array<string>")).isEmpty()
    assert got(spark, [("a", "x")], 5) == {"a": {"x"}}
