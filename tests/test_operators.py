from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import access, gluing, graph, joins, poset, sets, stats, topology, triples, validate, workloads
from factloom.operators.access import Kind, Query


def slot(x):
    base = dict.fromkeys(("kind", "ref", "str", "lng", "dbl", "bool", "type_hint"))
    if isinstance(x, str) and x.startswith("@"):
        return base | {"kind": "ref", "ref": x[1:], "type_hint": "ENTITY"}
    if isinstance(x, bool):
        return base | {"kind": "bool", "bool": x, "type_hint": "ATTRIBUTE"}
    if isinstance(x, int):
        return base | {"kind": "int", "lng": x, "type_hint": "QUANTITY"}
    if isinstance(x, float):
        return base | {"kind": "float", "dbl": x, "type_hint": "QUANTITY"}
    return base | {"kind": "str", "str": x, "type_hint": "ATTRIBUTE"}


def fact(i, subject="alice", relation="knows", objects=(), attributes=None, context="world", confidence=1.0, start=None, end=None, source="test", method="manual", seq=0, metadata=None):
    return {
        "fact_id": i,
        "subject": subject,
        "relation": relation,
        "objects": [slot(o) for o in objects],
        "attributes": [{"key": k, "value": slot(v)} for k, v in sorted((attributes or {}).items())],
        "context": context,
        "confidence": confidence,
        "provenance": {"source": source, "recorded_at": datetime(2024, 1, 1), "confidence": confidence, "method": method},
        "valid_start": start,
        "valid_end": end,
        "metadata": metadata,
        "seq": seq,
    }


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), V.FACT)


def ids(df, column="fact_id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize("arity", [0, 3, 5, 8, 12])
def test_reify_and_back(table, arity):
    f = table(fact("f", objects=[*(f"obj_{k}" for k in range(arity))], attributes={"a": 1, "b": 2.5, "c": True, "d": "x"}, start=datetime(2020, 1, 1), metadata='{"k":"v"}'))
    back = triples.reconstruct(triples.reify(f))
    assert f.exceptAll(back).isEmpty() and back.exceptAll(f).isEmpty()
    assert triples.reify(f).count() == 9 + arity + 4 + 1 + 1


def test_facts_come_back_from_triples_in_any_order(table, spark):
    """Runs that cross batches, scattered triples, one long event, an object that is null, an event of its type alone and a part that stands twice."""
    some = [fact(f"f{k}", f"s{k % 7}", objects=["@a", 2, 3.5, True, "x"][: k % 6], attributes={"a": k, "b": "y"} if k % 2 else None, start=datetime(2020, 1, 1) if k % 3 else None, metadata='{"z":"1","a":"2"}' if k % 5 == 0 else None) for k in range(60)]
    f = table(*some, fact("long", objects=[*range(300)]), fact("void") | {"objects": [None, slot("x")]})
    t = triples.reify(f)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        back = triples.reconstruct(t)
        assert f.exceptAll(back).isEmpty() and back.exceptAll(f).isEmpty()
        dealt = triples.reconstruct(t.repartition(5)).drop("metadata")  # the order of keys is not in triples
        assert f.drop("metadata").exceptAll(dealt).isEmpty() and dealt.count() == f.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    bare = triples.reify(table(fact("bare"))).where("predicate = 'rdf:type'")
    twice = triples.reify(table(fact("twice", "b", objects=["x"]))).unionByName(triples.reify(table(fact("twice", "c"))).where("predicate = 'rdf:subject'")).coalesce(1)
    got = {r.fact_id: (r.subject, len(r.objects)) for r in triples.reconstruct(bare.unionByName(twice)).collect()}
    assert got == {"bare": (None, 0), "twice": ("c", 1)}


def test_statements_of_a_fact_at_a_time(table):
    f = table(fact("a", objects=["@b", 2, 2.5, "x", True], attributes={"k": "v", "n": 3}), fact("none"), fact("only", attributes={"k": None})).unionByName(table(fact("null") | {"objects": None, "attributes": None}, fact("gap") | {"objects": [None, slot("y")]}))
    got, want = triples.apart(triples.grouped(f)), triples.statements(f)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 10


def test_no_grouping_where_triples_are_read(table):
    """Facts are put together after one exchange; a grouping below it would sort a row for each triple."""
    plan = triples.reconstruct(triples.reify(table(fact("f"))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.split("Exchange")[1]


def test_mixed_objects_and_neighbourhood(table):
    f = table(fact("f", "alice", "signed", ["@bob", "contract", "@acme", "@carol", "bob"]), fact("g", "bob"), fact("h", "dave", objects=["bob"]))
    assert ids(access.run(f, Query(Kind.NEIGHBORHOOD, subject="bob"))) == ["f", "g"]
    assert ids(access.neighborhood(f, "bob", subject_only=True)) == ["g"]
    assert sorted(r.dst for r in triples.edges(f).collect()) == ["acme", "bob", "carol"]


def test_contexts_inherit_downwards(table):
    f = table(fact("a", context="world.research"), fact("b", context="world.research.physics"), fact("c", context="ctx.0"))
    assert ids(access.run(f, Query(Kind.CONTEXT, context="world.research"))) == ["a", "b"]
    assert ids(access.context_visible_from(f, "world.research.physics")) == ["a", "b"]
    assert ids(access.run(f, Query(Kind.CONTEXT, context="world"))) == ["a", "b", "c"]


def test_temporal(table):
    y = lambda k: datetime(k, 1, 1)
    f = table(fact("a", start=y(2015), end=y(2016)), fact("b", start=y(2019), end=y(2030)), fact("c", start=y(2018)), fact("d"))
    assert ids(access.temporal(f, "2024-01-01")) == ["b", "c"]
    assert ids(access.run(f, Query(Kind.TEMPORAL, start="2015"))) == ["a"]
    assert ids(access.run(f, Query(Kind.TEMPORAL))) == ["a", "b", "c"]


def test_pages(table):
    f = table(*(fact(f"f{k}") for k in range(5)))
    assert ids(access.run(f, Query(Kind.GLOBAL, limit=2, offset=1))) == ["f1", "f2"]
    assert access.run(f, Query(Kind.GLOBAL, limit=0)).count() == 0


def test_current_takes_the_last_version(table):
    f = table(fact("a", relation="old", seq=1), fact("a", relation="new", seq=2))
    assert [r.relation for r in access.current(f).collect()] == ["new"]


def test_gluing_merges_what_agrees(table):
    f = table(
        fact("f", objects=["@bob"], attributes={"x": 1}, context="world.research", seq=1, confidence=0.5),
        fact("f", objects=["@bob"], attributes={"y": 2}, context="world.2024", start=datetime(2024, 6, 1), seq=2, source="unknown", confidence=0.9),
        fact("f", objects=["@bob"], context="world.provenance", source="dblp", seq=3, end=datetime(2025, 1, 1)),
        fact("g", objects=["@bob"]),
    )
    (g,) = gluing.global_sections(f).collect()
    assert (g.fact_id, g.context, g.confidence, g.provenance.source) == ("f", "world", 1.0, "dblp")
    assert [a.key for a in g.attributes] == ["x", "y"] and (g.valid_start, g.valid_end) == (datetime(2024, 6, 1), datetime(2025, 1, 1))


@pytest.mark.parametrize(
    "one, two, reason",
    [
        ({"objects": ["@bob"]}, {"objects": ["@charlie"]}, "objects"),
        ({"relation": "a"}, {"relation": "b"}, "relation"),
        ({"attributes": {"k": 1}}, {"attributes": {"k": 2}}, "attribute"),
        ({"start": datetime(2020, 1, 1), "end": datetime(2021, 1, 1)}, {"start": datetime(2022, 1, 1)}, "interval"),
    ],
)
def test_gluing_conflicts(table, one, two, reason):
    f = table(fact("f", **one, seq=1), fact("f", **two, seq=2))
    assert gluing.global_sections(f).isEmpty()
    assert [(r.fact_id, r.reason) for r in gluing.conflicts(f).collect()] == [("f", reason)]


def test_cover_gluing(table):
    good = table(fact("f", objects=["1"], context="world.2024", seq=1), fact("f", objects=["1"], context="world.2025", seq=2))
    bad = table(fact("f", objects=["1"], context="world", seq=1), fact("f", objects=["2"], context="world.2024", seq=2))
    assert [(r.context, r.agrees) for r in gluing.glue_cover(good, "world").collect()] == [("world", True)]
    assert [r.agrees for r in gluing.glue_cover(bad, "world").collect()] == [False]
    assert ids(gluing.at_root(bad)) == ["f"]


def test_topology(table, spark):
    f = table(fact("f1", objects=["@bob"], context="world.a"), fact("f2", "bob", context="world.a.b"))
    m = topology.members(f)
    names = {r.open_set for r in m.where("fact_id = 'f2'").collect()}
    assert {"event:f2", "entity:bob", "temporal:atemporal", "context:world", "context:world.a", "context:world.a.b", "source:test", "method:manual"} == names
    assert ids(topology.restrict(m, f, "entity:bob", "context:world.a.b")) == ["f2"]
    pairs = {(r.source, r.target) for r in topology.restriction_edges(m).collect()}
    assert ("context:world.a", "context:world.a.b") in pairs and ("context:world.a.b", "context:world.a") not in pairs
    sets_ = spark.createDataFrame([("u", "e", "1"), ("u", "e", "2"), ("v", "e", "2"), ("v", "e", "3")], "open_set string, kind string, fact_id string")
    assert sorted(r.points for r in topology.intersection_closure(sets_).collect()) == [["1", "2"], ["2"], ["2", "3"]]
    assert {r.axiom: r.violations for r in topology.axiom_report(f, m).collect()}["gluing"] == 0


def test_poset(table):
    p = poset.contexts(table(fact("a", context="w.a.b"), fact("b", context="w.c")))
    assert sorted((r.context, r.child) for r in poset.cover(p).collect()) == [("w", "w.a"), ("w", "w.c"), ("w.a", "w.a.b")]
    assert ids(poset.leaves(p), "context") == ["w.a.b", "w.c"]


def test_walks_end_on_cycles(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "s", "d")], "src string, relation string, dst string").withColumn("fact_id", F.concat("src", "dst"))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.walk(e, seeds, "r", 5).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.node: r.depth for r in graph.walk(e, seeds, None, 3).collect()}["d"] == 3
    assert ids(graph.walked_facts(e, seeds, "r", 2)) == ["ab", "bc"]
    assert sorted(r.path for r in graph.paths(e, "a", "d", 4).collect()) == [["a", "b", "c", "d"]]
    assert graph.reaches(e, "a", "d") and not graph.reaches(e, "d", "a")


def test_lineage_and_chain_survive_cycles(spark):
    d = spark.createDataFrame([("x", "y", 0), ("x", "z", 1), ("y", "x", 0), ("z", "w", 0)], "child string, parent string, pos int")
    start = spark.createDataFrame([("x",)], "start string")
    assert [r.node for r in graph.chain(d, start).orderBy("step").collect()] == ["x", "y"]
    assert {r.node: r.depth for r in graph.lineage(d, start).collect()} == {"x": 0, "y": 1, "z": 1, "w": 2}


def test_deep_derivations_are_followed_to_their_end(spark):
    n = 104
    d = spark.createDataFrame([(f"n{k}", f"n{k + 1}", 0) for k in range(n)], "child string, parent string, pos int").coalesce(1).cache()
    start = spark.createDataFrame([("n0",)], "start string")
    assert [(r.step, r.node) for r in graph.chain(d, start).orderBy("step").collect()] == [(k, f"n{k}") for k in range(n + 1)]
    assert {r.node: r.depth for r in graph.lineage(d, start).collect()} == {f"n{k}": k for k in range(n + 1)}
    for follow in (graph.chain, graph.lineage):
        with pytest.raises(ValueError):
            follow(d, start, limit=3)
        assert follow(d.where("child >= 'n101'"), start.select(F.lit("n101").alias("start")), limit=3).count() == 4


def test_high_arity(table):
    f = table(fact("a", relation="r", objects=["@x", 1, "t"]), fact("b", relation="r", objects=["@x"]), fact("c", relation="r"))
    assert ids(joins.high_arity_lookup(f, "r", {0: "x", 1: 1})) == ["a"]
    pairs = {(r.left_id, r.right_id) for r in joins.high_arity_join(f, f, 1, 1).collect()}
    assert ("b", "c") in pairs and ("a", "b") not in pairs


def test_windows_without_facts_count_nothing(table):
    f = table(fact("a", objects=[4.0], start=datetime(2024, 1, 2), end=datetime(2024, 1, 9)))
    got = workloads.fill_windows(workloads.temporal_aggregation(f, "2024-01-01", 7), "2024-01-01", "2024-01-22", 7)
    assert [(r.n, r.mean) for r in got.orderBy("window_start").collect()] == [(1, 4.0), (1, 4.0), (0, 0.0)]


def test_sets(table):
    a, b = table(fact("a"), fact("b")), table(fact("b"), fact("c"))
    assert ids(sets.union(a, b)) == ["a", "b", "c"] and ids(sets.intersection(a, b)) == ["b"] and ids(sets.difference(a, b)) == ["a"]
    assert sets.equivalent(a, a.union(a)) and not sets.equivalent(a, b)


def test_statistics(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1, 101)], "x double")
    row = stats.ranked(df, "x").first()
    assert (row.p50, row.p95, row.p99) == (51.0, 96.0, 100.0)
    d = stats.describe(df, "x").first()
    assert d.median == 50.5 and abs(d.variance - 833.25) < 1e-9
    b = stats.bootstrap(df, "x", "x", rounds=200).first()
    assert b.low < 50.5 < b.high
    dealt = stats.bootstrap(df.repartition(7), "x", "x", rounds=200).first()
    assert abs(dealt.low - b.low) < 1e-9 and abs(dealt.high - b.high) < 1e-9
    assert spark.range(1).select(stats.ratio(F.lit(1), F.lit(0)).alias("r")).first().r == float("inf")


def test_validation(table):
    bad = table(fact(""), fact("b", confidence=1.5), fact("c", end=datetime(2020, 1, 1)), fact("d", start=datetime(2021, 1, 1), end=datetime(2020, 1, 1)), fact("e"), fact("e"), fact("f", objects=["@nobody"]))
    messages = sorted(r.message for r in validate.report(bad).collect())
    assert messages == ["confidence is not within 0 and 1", "fact id is empty", "fact id is not unique", "interval ends before it starts", "interval ends without a start", "reference to nothing known: nobody"]
    with pytest.raises(ValueError):
        validate.role_matches(F.col("x"), "NONSENSE")
