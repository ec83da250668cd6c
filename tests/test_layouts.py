"""Bucketed layouts: what they read, that joins need no exchange, and that hot terms lose nothing."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import triples
from factloom.plans import layouts as layouts_module
from factloom.plans import planner, sparql
from factloom.plans.layouts import Layouts


@pytest.fixture(scope="module")
def statements(spark):
    """A chain of nodes, and a hub that a third of all statements point to and some leave."""
    chain = spark.range(300).selectExpr("concat('n', id) as s", "'next' as p", "concat('n', id + 1) as o", "cast(null as double) as num", "concat('f', id) as fact_id")
    to = spark.range(200).selectExpr("concat('n', id) as s", "'to' as p", "'hub' as o", "cast(null as double) as num", "concat('t', id) as fact_id")
    leave = spark.range(40).selectExpr("'hub' as s", "'next' as p", "concat('n', id) as o", "cast(null as double) as num", "concat('h', id) as fact_id")
    odd = spark.createDataFrame([("x", "next", None, 2.0, "o1"), ("n5", "next", "n6", None, "again"), ("", "", "", None, "o2")], "s string, p string, o string, num double, fact_id string")
    return chain.union(to).union(leave).union(odd).cache()


@pytest.fixture(scope="module")
def layouts(spark, statements, tmp_path_factory):
    return Layouts.build(statements, str(tmp_path_factory.mktemp("l") / "x"), 8)


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


TEXTS = [
    "SELECT ?a ?c WHERE { ?a next ?b . ?b next ?c }",
    "SELECT ?a ?c WHERE { ?a to ?b . ?b next ?c }",
    "SELECT ?a ?b ?c WHERE { ?a next ?b . ?a to ?c }",
    "SELECT ?a ?b WHERE { ?a next ?x . ?b next ?x }",
    "SELECT ?a ?d WHERE { ?a next ?b . ?b next ?c . ?c to ?d }",
    "SELECT ?p ?o WHERE { n5 ?p ?o }",
    "SELECT ?a ?c WHERE { ?a to hub . ?a next ?c }",
    "SELECT ?a ?b WHERE { ?a next ?b OPTIONAL { ?b to ?c } FILTER(?a != 'n3') }",
    "SELECT ?a WHERE { { ?a to hub } UNION { hub next ?a } }",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_rows_as_without(statements, layouts, text):
    assert same(sparql.run(layouts, text), sparql.run(statements, text))


def test_hot_terms_are_apart(layouts, statements):
    assert layouts.hot == {"hub"}
    assert layouts.table("hot_o").where("o = 'hub'").count() == 200 and layouts.table("pos").where("o = 'hub'").isEmpty()
    assert layouts.table("hot_s").count() == 40
    for name in ("spo", "osp", "pos"):
        side = "hot_s" if name == "spo" else "hot_o"
        assert same(layouts.table(name).union(layouts.table(side)), statements)


@pytest.mark.parametrize("bound", [{}, {"s": "n7"}, {"s": "hub"}, {"o": "n7"}, {"o": "hub"}, {"p": "to"}, {"p": "next", "o": "n9"}, {"s": "n7", "o": "n8"}, {"s": "none"}, {"s": ""}])
def test_scans(layouts, statements, bound):
    assert same(layouts.scan(**bound), triples.match(statements, **bound))


def test_joins_need_no_exchange(spark, layouts):
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (a, b), _ = layouts.sides("o", "s")
        plan = planner.explain(a.where("p = 'next'").select("s", "o").join(b.where("p = 'next'").selectExpr("s as o", "o as z"), "o"))
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        whole = planner.explain(sparql.run(layouts, TEXTS[0]))
        assert whole.count("Bucketed: true") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_bound_terms_read_one_bucket(spark, layouts):
    had = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task a file
    try:
        assert layouts.table("spo").rdd.getNumPartitions() > 1
        assert layouts.scan(s="n7").rdd.getNumPartitions() == 1 == layouts.scan(p="next", o="n7").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", had)


@pytest.mark.parametrize("tables, relations", [(tuple(layouts_module.BUCKETED), None), (("spo", "osp"), ("next", "to"))])
def test_statements_of_a_fact_at_a_time(spark, statements, tmp_path, tables, relations):
    """Grouped statements give the tables of single ones; an exchange carries packs, no row for each."""
    groups = statements.groupBy("s", "fact_id").agg(F.collect_list(F.struct("p", "o", "num")).alias("x")).select("s", "x.p", "x.o", "x.num", "fact_id").coalesce(2).cache()
    moved = [groups.count() and shuffled(spark)]
    one = Layouts.build(statements, str(tmp_path / "a"), 8, tables, relations)
    moved.append(shuffled(spark))
    two = Layouts.build(groups, str(tmp_path / "b"), 8, tables, relations)
    moved.append(shuffled(spark))
    assert moved[2] - moved[1] < moved[1] - moved[0] - one.table("spo").count()
    assert two.hot == one.hot == {"hub"}
    for name in (*tables, "hot_s", "hot_o"):
        assert same(two.table(name), one.table(name))


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_files_are_small(layouts):
    """Tables and what is hot are of sorted columns, which zstd takes half the room for."""
    found = list(Path(layouts.path).rglob("part-*.parquet"))
    assert found and all(p.name.endswith("zstd.parquet") for p in found)


def test_opened_again(spark, layouts, statements):
    again = Layouts.open(spark, layouts.path)
    assert again.hot == layouts.hot and again.buckets == 8
    assert same(again.scan(p="next"), triples.match(statements, p="next"))
    assert same(sparql.run(again, TEXTS[0]), sparql.run(statements, TEXTS[0]))
    again.close()
    assert not spark.catalog.tableExists(f"{again.prefix}_spo")
    assert layouts.scan(s="n7").count() == 2


def test_empty(spark, statements, tmp_path):
    x = Layouts.build(statements.limit(0), str(tmp_path / "x"), 4)
    assert x.scan().isEmpty() and sparql.run(x, TEXTS[0]).isEmpty() and not x.hot


def test_what_patterns_ask_alone(spark, statements, tmp_path):
    """Tables and relations that the patterns need give the same rows; others are not written, and asking for them raises."""
    x = Layouts.build(statements, str(tmp_path / "x"), 8, ("spo",), ("next", "to"))
    assert same(sparql.run(x, TEXTS[2]), sparql.run(statements, TEXTS[2]))
    assert not (tmp_path / "x" / "osp").exists() and not (tmp_path / "x" / "statements").exists()
    with pytest.raises(ValueError, match="osp is not among"):
        x.scan(o="n7")
    assert same(sparql.run(Layouts.open(spark, x.path), TEXTS[2]), sparql.run(statements, TEXTS[2]))


def test_buckets_grow_with_the_statements(spark, statements, tmp_path, monkeypatch):
    """A bucket, which one task sorts, has as many rows however many there are; frequent terms are found by groups first."""
    monkeypatch.setattr(layouts_module, "BUCKET_ROWS", 20)
    x = Layouts.build(statements, str(tmp_path / "x"), 4)
    assert x.buckets == -(-statements.count() // 20) and x.hot == {"hub"}
    assert same(sparql.run(x, TEXTS[0]), sparql.run(statements, TEXTS[0]))
    assert same(x.scan(p="next", o="n9"), triples.match(statements, p="next", o="n9")) and same(x.scan(o="n9"), triples.match(statements, o="n9"))
    assert layouts_module.frequent(statements, ["o", "s"], 39, 2) == ["hub"] and layouts_module.frequent(statements, ["s"], 40, 2) == []
