"""Nested scopes of the pattern language: sub-selects, EXISTS, prefixes."""

from __future__ import annotations

import pytest

from factloom.plans import sparql


@pytest.fixture(scope="module")
def st(spark):
    rows = [("a", "knows", "b", None), ("b", "knows", "c", None), ("c", "knows", "a", None), ("a", "age", None, 3.0), ("b", "age", None, 5.0), ("http://e/x", "knows", "c", None), ("d", "knows", None, 1.0)]
    return spark.createDataFrame([(*r, f"f{k}") for k, r in enumerate(rows)], "s string, p string, o string, num double, fact_id string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sub_select(st):
    text = "SELECT ?x ?n WHERE { ?x age ?n { SELECT ?x WHERE { ?x knows ?y FILTER(?y != 'c') } } }"
    assert rows(sparql.run(st, text, numbers=("n",))) == [("a", 3.0)]
    counted = "SELECT ?y ?n WHERE { <a> knows ?y { SELECT ?y (COUNT(*) AS ?n) WHERE { ?z knows ?y } GROUP BY ?y } }"
    assert rows(sparql.run(st, counted, numbers=("n",))) == [("b", 1.0)]
    top = "SELECT ?x ?y WHERE { ?x knows ?y { SELECT ?x WHERE { ?x age ?n } ORDER BY DESC(?n) LIMIT 1 } }"
    assert rows(sparql.run(st, top)) == [("b", "c")]
    hidden = "SELECT ?x ?y WHERE { ?x age ?n { SELECT ?x WHERE { ?x knows ?y } } }"  # ?y is the sub-select's own
    assert {r[1] for r in rows(sparql.run(st, hidden))} == {""}


def test_exists(st):
    assert rows(sparql.run(st, "SELECT ?x WHERE { ?x knows ?y FILTER EXISTS { ?x age ?n } }")) == [("a",), ("b",)]
    assert rows(sparql.run(st, "SELECT ?x WHERE { ?x knows ?y FILTER NOT EXISTS { ?x age ?n FILTER(?n > 4) } }")) == [("a",), ("c",), ("d",), ("http://e/x",)]
    got = rows(sparql.run(st, "SELECT ?x ?old WHERE { ?x knows ?y BIND(EXISTS { ?x age ?n FILTER(?n > 4) } AS ?old) }"))
    assert got == [("a", "false"), ("b", "true"), ("c", "false"), ("d", "false"), ("http://e/x", "false")]
    assert rows(sparql.run(st, "SELECT ?x WHERE { ?x knows ?y BIND(EXISTS { ?x age ?n } AS ?old) FILTER(?old = 'true') }")) == [("a",), ("b",)]


def test_prefixes(st):
    assert rows(sparql.run(st, "PREFIX e: <http://e/> SELECT ?y WHERE { e:x knows ?y }")) == [("c",)]
    assert rows(sparql.run(st, "PREFIX : <http://e/> PREFIX f: <http://f/> SELECT ?y WHERE { f:x knows ?y }")) == []


@pytest.mark.parametrize("text", ["SELECT ?x WHERE { ?x a ?y FILTER EXISTS { ?p b ?q } }", "SELECT ?x WHERE { ?x a ?y BIND(EXISTS { ?x b ?z } AS ?y) }", "SELECT ?x WHERE { ?x a ?y BIND(?y AS ?z) }", "SELECT ?x WHERE { { SELECT ?x WHERE { ?x a ?y } }", "SELECT ?x WHERE { ?x a b } }", "PREFIX e <http://e/> SELECT ?x WHERE { ?x a b }"])
def test_refused(st, text):
    with pytest.raises(sparql.SparqlError):
        sparql.run(st, text)
