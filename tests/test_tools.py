from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import canonical, render, sets, triples
from factloom.operators.access import Kind, Query
from factloom.plans import config, planner, suite, templates
from factloom.sources import files, generators
from tests.test_operators import fact, table  # noqa: F401


def test_canonical_model(table):  # noqa: F811
    f = table(fact("1", "user/a", "knows", ["@user/b"]), fact("2", "user/b", "knows", ["@user/a", 3]), fact("3", "x"))
    assert {r.entity: (r.kind, r.n_facts) for r in canonical.entities(f).collect()} == {"user/a": ("user", 2), "user/b": ("user", 2), "x": ("UNKNOWN", 1)}
    assert {(r.relation, r.slots) for r in canonical.relations(f).collect()} == {("knows", "ref"), ("knows", "ref,int"), ("knows", "")}
    model = canonical.relations(f).where("arity = 1")
    got = {r.fact_id: (r.subject_kind, r.conforms) for r in canonical.described(f, canonical.entities(f).where("kind = 'user'"), model).collect()}
    assert got == {"1": ("user", True), "2": ("user", False), "3": ("UNKNOWN", False)}
    assert canonical.equal_models(f, f.orderBy("fact_id")) and not canonical.equal_models(f, f.where("fact_id <> '3'"))


def test_rendering(table, spark):  # noqa: F811
    f = table(fact("1", "a", 'say "hi"', ["@b"]), fact("2", "b", "r", ["@c"]))
    e = triples.edges(f)
    assert render.dot(e) == 'digraph facts {\n  "a" -> "b" [label="say \\"hi\\""];\n  "b" -> "c" [label="r"];\n}'
    assert '"c"' not in render.neighborhood(e, "a", 1) and '"c"' in render.neighborhood(e, "a", 2)
    assert "rdf:subject" in render.event(triples.reify(f), "1")
    with pytest.raises(ValueError):
        render.dot(e, most=1)


def test_templates(table):  # noqa: F811
    st = triples.statements(table(fact("1", "a", "r", ["@b"]), fact("2", "b", "q", ["@c"])))
    assert [tuple(r) for r in templates.run(st, "two_hops", relation="r", next="q").collect()] == [("a", "c")]
    assert len(list(templates.grid("range", relation=["r", "q"], low=[0, 1], high=[5]))) == 4
    for bad in ({"subject": "x } UNION {"}, {"wrong": "x"}):
        with pytest.raises(ValueError):
            templates.render("lookup", **bad)
    for name, text in templates.TEMPLATES.items():
        assert "{" in text


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("profile: minimal  # note\nshuffle_partitions: 7\n")
    c = config.load(str(tmp_path / "c.yaml"), {"FACTLOOM_SEED": "3"}, store="x")
    assert (c.profile, c.shuffle_partitions, c.seed, c.store) == ("minimal", 7, 3, "x")
    assert c.spark_settings()["spark.sql.shuffle.partitions"] == "7"
    for bad in ({"nope": 1}, {"profile": "none"}, {"most_rows": 0}):
        with pytest.raises(ValueError):
            config.load(None, {}, **bad)


def test_suite(spark):
    f = generators.synthetic(spark, 300)
    rows = suite.measure(spark, f, runs=1).collect()
    assert len(rows) == 2 * len(suite.CLASSES) and all(r.agrees for r in rows)
    assert suite.scaling(spark, lambda n: generators.synthetic(spark, n), [10, 20], lambda d: d).count() == 2
    before = spark.conf.get("spark.sql.adaptive.enabled")
    assert suite.sensitivity(spark, "spark.sql.adaptive.enabled", ["true", "false"], lambda: f.groupBy("relation").count()).count() == 2
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_slots_are_one_struct():
    assert V.VALUE.fieldNames() == ["kind", "ref", "str", "lng", "dbl", "bool", "type_hint"]
    assert Query(Kind.GLOBAL).limit is None


def test_same_rows_by_one_grouping(spark):
    """Multisets of rows, nulls and columns in another order included; one exchange for all sides."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, `a.b` string")
    b = a.select("`a.b`", "k")
    assert sets.same_rows(a, b, a) and not sets.same_rows(a, b, a.distinct()) and not sets.same_rows(a.distinct(), a)
    assert sets.equivalent(a, a.distinct()) and not sets.equivalent(a, a.where("k = 1"))
    assert planner.explain(sets._counted(a, b, a)).count("+- Exchange (") == 1


def test_round_trips_tell_what_json_loses(spark, table, tmp_path):  # noqa: F811
    f = table(fact("1", "a", objects=["@b", 3]), fact("2", "c"))
    assert files.round_trips(f, str(tmp_path / "a"))
    assert [p for p in (tmp_path / "a" / "j").glob("part-*.gz")]
    assert not files.round_trips(f.withColumn("valid_start", F.expr("timestamp_ntz'2020-01-01 00:00:00.123456'")), str(tmp_path / "b"))
