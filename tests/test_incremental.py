"""A followed topology equals one built anew."""

from __future__ import annotations

from factloom.operators import topology
from factloom.operators.incremental import Topology
from tests.test_operators import fact, table  # noqa: F401

KINDS = ("event", "entity", "temporal", "context", "provenance")


def state(t):
    return [sorted(map(tuple, x.collect())) for x in (t.members.select("open_set", "kind", "fact_id"), t.sizes.select("kind", "open_set", "n"), t.shared.select("source", "target", "n"), t.edges())]


def test_followed_equals_built(table):  # noqa: F811
    facts = {str(k): fact(str(k), f"s{k % 3}", objects=[f"@o{k % 2}"], context=["world.a", "world.a.b", "world"][k % 3], method=f"m{k % 2}") for k in range(8)}
    t = Topology.build(table(*facts.values()), KINDS)
    steps = [
        ({"8": fact("8", "new", objects=["@o1", "@o2"], context="world.c.d")}, []),
        ({"0": fact("0", "s0", objects=["@o0"], context="world.a.b", method="m9"), "1": fact("1", "s1", objects=["@o1"], context="world.a.b", method="m1")}, []),
        ({}, ["2", "5", "none"]),
        ({"2": fact("2", "back")}, ["8"]),
        ({}, list("0123467")),
    ]
    for put, gone in steps:
        facts = {k: v for k, v in (facts | put).items() if k not in gone}
        ids = table(*(fact(i) for i in [*put, *gone]))
        t = t.changed(ids, table(*put.values()))
        built = Topology.build(table(*facts.values()), KINDS)
        assert state(t) == state(built)
    assert not facts and t.sizes.isEmpty()
    some = table(fact("1", "a", context="world.x"), fact("2", "b", context="world.x.y"))
    assert sorted(map(tuple, Topology.build(some, KINDS).edges().collect())) == sorted(map(tuple, topology.restriction_edges(topology.members(some, KINDS)).collect()))


def test_points_are_rows_of_facts(table):  # noqa: F811
    """What a change writes again is a row a fact, not one for each of its sets; versions of a fact are one row."""
    t = Topology.build(table(fact("1", "a"), fact("1", "b"), fact("2", "c")), KINDS)
    assert t.points.count() == 2 and t.members.where("fact_id = '1' and open_set in ('entity:a', 'entity:b')").count() == 2
