"""Chains, ancestors, hubs and reachability of many starts against plain Python, cycles and hubs included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import ancestry, doubling, graph
from factloom.operators.hubs import Spread
from factloom.plans import planner

DERIVED = "child string, parent string, pos int"


def chain_of(first, node):
    seen = [node]
    while (node := first.get(node)) is not None and node not in seen:
        seen.append(node)
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_all(spark, seed):
    rng = random.Random(seed)
    n = 60
    rows = [(f"n{k}", f"n{k // 2 if seed == 0 else rng.randrange(n)}", 0) for k in range(1, n) if rng.random() < 0.9]
    rows += [(f"n{k}", f"n{rng.randrange(n)}", 1) for k in range(n) if rng.random() < 0.3] + [("a", "a", 0), ("b", "c", 0), ("c", "b", 0), ("d", "b", 0)]
    first: dict = {}
    for c, p, pos in sorted(rows, key=lambda r: (r[2], r[1])):
        first.setdefault(c, p)
    nodes = {x for c, p in first.items() for x in (c, p)}
    got = doubling.chains(spark.createDataFrame(rows, DERIVED)).collect()
    assert sorted((r.start, r.step, r.node) for r in got) == sorted((s, k, x) for s in nodes for k, x in enumerate(chain_of(first, s)))
    some = spark.createDataFrame([("d",), ("nowhere",), ("d",)], "start string")
    assert sorted(map(tuple, doubling.chains(spark.createDataFrame(rows, DERIVED), some).collect())) == [("d", 0, "d"), ("d", 1, "b"), ("d", 2, "c"), ("nowhere", 0, "nowhere")]


def test_all_chains_of_150_levels(spark):
    d = spark.range(1, 151).selectExpr("concat('n', id) as child", "concat('n', id - 1) as parent", "0 as pos")
    got = doubling.chains(d).groupBy("start").agg(F.max("step").alias("last"), F.count("*").alias("n")).collect()
    assert {(int(r.start[1:]), r.last, r.n) for r in got} == {(k, k, k + 1) for k in range(151)}


@pytest.mark.parametrize("seed", range(1))
def test_ancestors_of_all(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(34)}
    above: dict = {}
    for c, p in edges:
        above.setdefault(c, set()).add(p)
    want = []
    for s in {x for e in edges for x in e}:
        depth, front = {s: 0}, [s]
        while front:
            front = [(depth.setdefault(p, depth[x] + 1), p)[1] for x in front for p in sorted(above.get(x, ())) if p not in depth]
        want += [(s, x, k) for x, k in depth.items()]
    got = doubling.ancestors(spark.createDataFrame([(*e, 0) for e in edges], DERIVED)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    empty = spark.createDataFrame([], DERIVED)
    assert doubling.ancestors(empty).isEmpty() and doubling.chains(empty).isEmpty()


@pytest.fixture(scope="module")
def hub(spark):
    """A third of all edges leave one node."""
    return spark.range(300).selectExpr("case when id < 100 then 'hub' else concat('n', id) end as src", "'r' as relation", "concat('n', (id * 7) % 300) as dst", "concat('f', id) as fact_id").cache()


def test_a_hub_is_split(spark, hub):
    edges = hub.select("src", "dst")
    spread = Spread(edges, "src", 30)
    assert [(r.src, r.ways) for r in spread.hubs.collect()] == [("hub", 4)]
    assert spread.edges.where("src = 'hub'").groupBy("salt").count().count() == 4
    front = spark.createDataFrame([("hub",), ("n150",), ("none",)], "src string")
    joined = spread.join(front)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, front.join(edges, "src").collect()))
    assert "salt" in planner.explain(joined) and "Generate" in planner.explain(joined)
    assert Spread(edges, "src").hubs is None


def test_walks_over_a_hub(spark, hub):
    seeds = spark.createDataFrame([("n130",), ("hub",)], "node string")
    a, b = (sorted(map(tuple, graph.walk(hub, seeds, None, 3, most).collect())) for most in (20, 10**6))
    assert a == b and len(a) > 100
    touch = hub.select("fact_id", F.explode(F.array("src", "dst")).alias("entity"))
    some = spark.createDataFrame([("f3",), ("f200",)], "seed string")
    a, b = (sorted(map(tuple, graph.fact_neighborhood(touch, some, 2, most).collect())) for most in (20, 10**6))
    assert a == b and len(a) > 100


def test_many_to_many(spark):
    rng = random.Random(4)
    edges = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)} | {(f"d{k}", f"d{k + 1}") for k in range(9)}
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def met(s):
        seen, front = {s}, [s]
        while front:
            front = [y for x in front for y in out.get(x, ()) if y not in seen and not seen.add(y)]
        return seen

    sources, targets = [f"n{k}" for k in range(0, 40, 3)] + ["d0", "lone", "d7"], [f"n{k}" for k in range(20)] + ["d9", "lone", "else"]
    one = lambda name, xs: spark.createDataFrame([(x,) for x in xs * 2], f"{name} string")
    e = spark.createDataFrame(sorted(edges), "src string, dst string").coalesce(1)
    got = graph.reachable(e, one("source", sources), one("target", targets), most=2)
    assert sorted(map(tuple, got.collect())) == sorted((s, t) for s in sources for t in targets if t in met(s))
    assert graph.reaches(e, "d0", "d9") and not graph.reaches(e, "d9", "d0")
    assert graph.reachable(e.limit(0), one("source", ["a"]), one("target", ["a", "b"])).collect() == [("a", "a")]


def test_neighborhood_sizes_make_no_pairs_of_hubs(spark, hub):
    """Seeds that share a hub, that have two, other entities within and outside of it, none, and one that is not there."""
    touch = hub.select("fact_id", F.explode(F.array("src", "dst")).alias("entity"))
    more = spark.createDataFrame([("f3", "big"), ("f3", "hub"), ("bare", None), ("f200", "n8"), *((f"b{k}", "big") for k in range(60)), ("b7", "n8")], "fact_id string, entity string")
    touch = touch.union(more).cache()
    seeds = spark.createDataFrame([(f"f{k}",) for k in (0, 1, 3, 99, 200, 200, 251)] + [("b7",), ("bare",), ("gone",)], "seed string")
    want = graph.fact_neighborhood(touch, seeds.distinct(), 1).groupBy("seed").agg(F.count("*").alias("n")).collect()
    for most in (1, 20, 70, 10**6):
        assert sorted(map(tuple, graph.neighborhood_sizes(touch, seeds, most).collect())) == sorted(map(tuple, want))
    assert {r.seed: r.n for r in want}["f3"] > 150


@pytest.mark.parametrize("seed", range(2))
def test_ancestor_totals(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", 0) for _ in range(45)] + [("a", "a", 0), ("b", None, 0), (None, "n1", 0), ("x", "top", 0)]
    d = spark.createDataFrame(rows, DERIVED)
    starts = d.select(F.col("child").alias("start")).distinct()
    pairs = doubling.ancestors(d).join(starts, "start")
    want = pairs.groupBy("node").agg(F.count("*").alias("n"), F.min("depth"), F.max("depth"), F.sum("depth"))
    assert sorted(map(tuple, ancestry.ancestor_totals(d).collect())) == sorted(map(tuple, want.collect()))


def test_descendants_are_few_runs(spark):
    """Where ids follow each other, the pairs of all nodes are no more than some runs a node."""
    n = 3000
    d = spark.range(1, n).selectExpr("concat('o', id) as child", "explode(array(struct(id div 2 as k, 0 as pos), struct(id div 3 as k, 1 as pos))) as x").selectExpr("child", "concat('o', x.k) as parent", "x.pos")
    nodes = ancestry.numbered(d)
    runs = ancestry.descendant_runs(d, nodes).cache()
    assert runs.count() < 4 * n < runs.agg(F.sum(F.expr("hi - lo"))).first()[0] / 5
    assert doubling.ancestors(d).count() == runs.agg(F.sum(F.expr("hi - lo"))).first()[0] + n


def test_most_rows_of_chains_are_not_written(spark, monkeypatch):
    """Only every eighth row of a chain is written; the rest unfolds from the nodes' own stretches."""
    written, cut = {}, doubling.cut

    def counted(df, name="step"):
        out = cut(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(doubling, "cut", counted)
    d = spark.range(1, 41).selectExpr("concat('n', id) as child", "concat('n', id - 1) as parent", "0 as pos")
    assert doubling.chains(d).count() == 41 * 42 // 2 and written["chain"] < 41 * 42 // 2 // 5
