from __future__ import annotations

import pytest

from factloom.functions.expressions import ExpressionError
from factloom.operators import graph, triples
from factloom.operators.access import Kind, Query
from factloom.operators.algebra import Aggregate, Filter, Scan
from factloom.plans import ablation, engine, language, planner, sparql
from factloom.plans.store import FactStore
from factloom.plans.unified import Ask, Form, ask
from tests.test_operators import fact, ids, table  # noqa: F401


@pytest.fixture
def facts(table):  # noqa: F811
    return table(
        fact("1", "alice", "knows", ["@bob"], {"age": 30}),
        fact("2", "bob", "knows", ["@carol"], {"age": 40}),
        fact("3", "carol", "works_at", ["@acme"], context="world.employment"),
        fact("4", "bob", "works_at", ["@acme"], context="world.employment"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sparql(facts):
    st = triples.statements(facts)
    assert rows(sparql.run(st, "SELECT ?x ?z WHERE { ?x knows ?y . ?y knows ?z }")) == [("alice", "carol")]
    assert rows(sparql.run(st, "SELECT ?x WHERE { ?x age ?a FILTER(?a > 30) }")) == [("bob",)]
    assert sorted(map(repr, sparql.run(st, "SELECT ?x ?w WHERE { ?x age ?a OPTIONAL { ?x works_at ?w } }").collect())) == ["Row(x='alice', w=None)", "Row(x='bob', w='acme')"]
    assert rows(sparql.run(st, "SELECT ?x (COUNT(*) AS ?n) WHERE { ?x ?p ?o } GROUP BY ?x HAVING(?n > 2)")) == [("bob", 3)]
    assert rows(sparql.run(st, "SELECT ?x ?missing WHERE { ?x knows bob }")) == [("alice", "")]
    assert [r.a for r in sparql.run(st, "SELECT ?a WHERE { ?x age ?a } ORDER BY DESC(?a) LIMIT 1", numbers=("a",)).collect()] == [40.0]


@pytest.mark.parametrize("text", ["SELECT WHERE { ?x a b }", "SELECT ?x WHERE { ?x a }", "SELECT ?x { ?x a b", "SELECT ?x WHERE { ?x a b } LIMIT", "SELECT ?x WHERE { }", "nonsense"])
def test_sparql_refuses(facts, text):
    with pytest.raises(sparql.SparqlError):
        sparql.run(triples.statements(facts), text)


def test_language(facts):
    t = {"facts": facts}
    assert rows(language.run("SELECT ?f.subject FROM facts ?f WHERE ?f.age >= 40", t)) == [("bob",)]
    assert rows(language.run("SELECT ?f FROM facts ?f CONTEXT(?f, 'world.employment') WHERE ?f.subject = 'bob'", t)) == [("4",)]
    assert rows(language.run("SELECT ?f.relation AS r, COUNT(*) AS n FROM facts ?f GROUP BY ?f.relation", t)) == [("knows", 2), ("works_at", 2)]
    assert rows(language.run("SELECT ?a.subject AS x, ?b.arg0 AS y FROM facts ?a JOIN facts ?b ON ?a.arg0 = ?b.subject WHERE ?b.relation = 'works_at'", t)) == [("alice", "acme"), ("bob", "acme")]
    assert len(language.run("SELECT * FROM facts", t).columns) == 12
    assert [r.f for r in language.run("SELECT ?f FROM facts ?f ORDER BY ?f.age DESC LIMIT 1", t).collect()] == ["2"]


@pytest.mark.parametrize(
    "text",
    ["SELECT FROM facts", "SELECT ?f FROM nowhere", "SELECT ?f.subject, COUNT(*) FROM facts ?f", "SELECT ?f FROM facts ?f LIMIT -1", "SELECT ?f FROM facts ?f CONTEXT(?f, '')", "SELECT ?f FROM facts ?f WHERE", "SELECT ?f FROM facts ?f CONTEXT(?g, 'x')"],
)
def test_language_refuses(facts, text):
    with pytest.raises((language.LanguageError, ExpressionError)):
        language.run(text, {"facts": facts})


def test_filters_fail_closed(facts):
    with pytest.raises(Exception):
        Filter(Scan("facts"), "no_such_column > 1").compile({"facts": facts}).collect()
    assert Aggregate(Scan("facts"), [], [("COUNT", "*", "n")]).compile({"facts": facts}).first().n == 4
    assert "Scan" in Filter(Scan("facts"), "confidence > 0").describe()


def test_planner(spark, facts):
    c = planner.choose(Query(Kind.LOOKUP, subject="bob"), planner.Statistics(1000, 12000))
    assert (c.path, c.scope) == ("facts", "local")
    assert "PushedFilters" in planner.explain(facts) or planner.explain(facts)
    with planner.profile(spark, "minimal"):
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_store(spark, facts, table, tmp_path):  # noqa: F811
    store = FactStore.create(spark, str(tmp_path / "s"), facts)
    store.insert(table(fact("5", "dave")))
    assert store.update(table(fact("1", "alice", "likes", ["@bob"]), fact("none"))) == 1
    assert store.delete(["2", "nobody"]) == 1
    assert ids(store.facts()) == ["1", "3", "4", "5"]
    assert [r.relation for r in store.query(Query(Kind.LOOKUP, subject="alice")).collect()] == ["likes"]
    assert rows(store.sparql("SELECT ?x WHERE { ?x works_at acme }")) == [("bob",), ("carol",)]
    assert rows(store.select("SELECT ?f FROM facts ?f WHERE ?f.subject = 'dave'")) == [("5",)]
    store.compact()
    assert ids(store.facts()) == ["1", "3", "4", "5"] == ids(store.versions())
    assert store.statistics()["facts"] == 4
    for form in ("json", "parquet"):
        store.export(str(tmp_path / form), form)
        other = FactStore.create(spark, str(tmp_path / f"o-{form}"))
        other.import_(str(tmp_path / form), form)
        assert other.facts().drop("seq").exceptAll(store.facts().drop("seq")).isEmpty() and other.facts().count() == 4
    assert {r.check for r in store.verify().collect()} >= {"versions disagree"}
    assert "facts" in store.explain(Query(Kind.GLOBAL))


def test_facts_and_triples_agree(facts):
    """One query on facts and on facts rebuilt from triples gives one result."""
    back = triples.reconstruct(triples.reify(facts))
    for q in (Query(Kind.LOOKUP, subject="bob"), Query(Kind.CONTEXT, context="world.employment"), Query(Kind.NEIGHBORHOOD, subject="acme"), Query(Kind.GLOBAL)):
        from factloom.operators import access

        assert ids(access.run(facts, q)) == ids(access.run(back, q))


def test_two_writers_take_their_own_numbers(spark, facts, table, tmp_path):  # noqa: F811
    a = FactStore.create(spark, str(tmp_path / "w"), facts)
    b = FactStore(spark, str(tmp_path / "w"))
    assert len({x._next_seq() for x in (a, b) for _ in range(3)}) == 6
    a.compact()
    assert ids(b.facts()) == ["1", "2", "3", "4"]
    assert a.clean() == 1 and a.clean() == 0 and ids(a.facts()) == ["1", "2", "3", "4"]


def test_engines(spark, facts):
    for name in sorted(engine.ENGINES):
        assert ids(engine.create(name, facts).query(Query(Kind.LOOKUP, subject="bob"))) == ["2", "4"]
    with pytest.raises(ValueError):
        engine.create("none", facts)
    with pytest.raises(ValueError):
        engine.register(engine.Engine)
    cache = engine.PlanCache(sparql.parse, 1)
    for text in ("SELECT ?x WHERE { ?x a b }", "SELECT ?y WHERE { ?y a b }", "SELECT ?x WHERE { ?x a b }"):
        cache.get(text)
    assert (cache.hits, cache.misses) == (0, 3)


def test_ablation_strategies(spark, facts):
    assert len(list(ablation.plans("pairwise"))) == 15 and list(ablation.plans("random_subset")) == list(ablation.plans("random_subset"))
    with pytest.raises(ValueError):
        list(ablation.plans("none"))
    r = ablation.Report(1.0, [(("a",), 2.0), (("b",), 0.5), (("a", "b"), 3.0)])
    assert r.worst_offenders(1) == [(("a", "b"), 3.0)] and r.biggest_improvements(1) == [(("b",), 0.5)] and r.speedups() == {"a": 2.0, "b": 0.5}


def test_a_chain_of_150_levels_is_whole(spark):
    d = spark.range(1, 151).selectExpr("concat('n', id) as child", "concat('n', id - 1) as parent", "0 as pos")
    start = spark.createDataFrame([("n150",)], "start string")
    assert sorted((r.step, r.node) for r in graph.chain(d, start).collect()) == [(k, f"n{150 - k}") for k in range(151)]
    some = spark.createDataFrame([("n30",)], "start string")
    assert sorted((r.depth, r.node) for r in graph.lineage(d, some).collect()) == [(k, f"n{30 - k}") for k in range(31)]


def test_unified_entry(facts):
    assert ids(ask(facts, Ask(Form.FACT, subject="bob", min_confidence=0.5))) == ["2", "4"]
    assert ids(ask(facts, Ask(Form.WALK, entities=("alice",), depth=2))) == ["1", "2", "4"]
    assert ids(ask(facts, Ask(Form.JOIN, relation="knows", entities=("alice", "bob")))) == ["1"]
    glued = ask(facts, Ask(Form.GLUE, context="world.employment")).collect()
    assert sorted((r.fact_id, r.agrees) for r in glued) == [("3", True), ("4", True)]
    for bad in (Ask(Form.WALK, entities=("a",)), Ask(Form.GLUE, subject="a"), Ask(Form.JOIN, entities=("a",)), Ask(Form.FACT, depth=1)):
        with pytest.raises(ValueError):
            ask(facts, bad)
