from __future__ import annotations

import json

import pytest

from factloom.sources import files, generators
from factloom.sources.turtle import TurtleError, parse
from factloom.streaming import ingest
from tests.test_operators import fact, table  # noqa: F401


def test_json_files(spark, tmp_path):
    rows = [{"subject": "a", "relation": "r", "objects": ["x", "y"], "context": "world.c", "confidence": 0.5}, {"subject": "b", "relation": "r"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n\n".join(map(json.dumps, rows)))
    for name in ("a.json", "b.jsonl"):
        got = {r.subject: r for r in files.load(spark, name, str(tmp_path / name)).collect()}
        assert [o.str for o in got["a"].objects] == ["x", "y"] and got["a"].context == "world.c"
        assert got["b"].objects == [] and got["b"].confidence == 1.0


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://a> <http://p> <http://b> .\n# note\n\n_:x <http://p> "q\\"t\\n"@en .\n')
    got = {r.subject: r.objects[0] for r in files.load(spark, "nt", str(tmp_path / "a.nt")).collect()}
    assert got["http://a"].ref == "http://b" and got["_:x"].str == 'q"t\n'
    (tmp_path / "bad.nt").write_text("this is no triple\n")
    with pytest.raises(Exception, match="not an N-Triples line"):
        files.load(spark, "nt", str(tmp_path / "bad.nt")).collect()


def test_turtle(spark, tmp_path):
    text = '@prefix ex: <http://e/> .\nex:a a ex:T ; ex:p ex:b, "two", 3 .\nex:b ex:q true .'
    assert len(list(parse(text))) == 5
    (tmp_path / "a.ttl").write_text(text)
    assert files.load(spark, "a.ttl", str(tmp_path / "a.ttl")).count() == 5
    with pytest.raises(TurtleError):
        list(parse("ex:a ex:p ex:b ."))


RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def test_turtle_nodes():
    text = '@prefix e: <http://e/> .\n[ e:p [ e:q 1 ; e:q 2, 3 ] ; ] .\ne:s e:list ( [ e:x "y" ] () ("z") ) , [] ; a e:T .\n[] e:p () .\n( 1 ) e:p [] .'
    got = list(parse(text, node="k"))
    nodes = {x for s, _, o, ref in got for x in ((s, o) if ref else (s,)) if x.startswith("_:")}
    assert len(nodes) == len({n.split("-")[1] for n in nodes}) == 11
    about = lambda p: [(s, o) for s, q, o, _ in got if q == p]
    (inner,) = {s for s, _ in about("http://e/q")}
    assert [o for _, o in about("http://e/q")] == ["1", "2", "3"] and inner in [o for _, o in about("http://e/p")]
    head = about("http://e/list")[0][1]
    first, rest = dict(about(RDF + "first")), dict(about(RDF + "rest"))
    items = []
    while head != RDF + "nil":
        items.append(first[head])
        head = rest[head]
    assert len(items) == 3 and dict(about("http://e/x")) == {items[0]: "y"} and items[1] == RDF + "nil" and first[items[2]] == "z"
    deep = "<http://a/b> <http://a/c> " + "[ <http://a/d> (" * 3000 + "1" + ") ]" * 3000 + " ."
    assert len(list(parse(deep))) == 1 + 3 * 3000
    for bad in ("<a:b> <a:c> [ <a:d> 1 .", "<a:b> <a:c> ( 1 ] .", "<a:b> .", "[ ] <a:c> .", "<a:b> <a:c> ; .", "<a:b> <a:c> 1 , .", "1 <a:c> 1 .", "<a:b> <a:c> 1", ") .", "<a:b> ( ) 1 ."):
        with pytest.raises(TurtleError):
            list(parse(bad))


def _bare(df):
    first = lambda v: v.ref if v.ref is not None else v.str
    return sorted((("_" if r.subject.startswith("_:") else r.subject), r.relation, ("_" if (first(r.objects[0]) or "").startswith("_:") else first(r.objects[0]))) for r in df.collect())


def test_a_large_turtle_file_is_read_by_several_tasks(spark, tmp_path):
    head = "@prefix e: <http://e/> .\n# said. Twice.\n@prefix f: <http://f/> .\n\n"
    body = "".join(f'e:s{k} e:p ( {k} "a. b" ) ;\n  f:q [ e:r "x{k}" ] .\n' for k in range(400))
    (tmp_path / "a.ttl").write_text(head + body + "e:last e:p 1.5 .")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.option("lineSep", ".\n").text(str(tmp_path / "a.ttl")).rdd.getNumPartitions() > 3
        found = files.read_turtle(spark, str(tmp_path / "a.ttl"))
        assert _bare(found) == sorted(("_" if s.startswith("_:") else s, p, "_" if ref and o.startswith("_:") else o) for s, p, o, ref in parse(head + body + "e:last e:p 1.5 ."))
        subjects = [r.subject for r in found.collect() if r.subject.startswith("_:")]
        assert len(set(subjects)) == 400 * 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_turtle_files_of_all_sorts(spark, tmp_path):
    texts = {
        "long": '@prefix e: <http://e/> .\ne:a e:p """one.\ntwo.\n""" .\n',
        "comment": "@prefix e: <http://e/> .\ne:b e:p # a note.\n 1 .\n",
        "twice": "@prefix e: <http://e/> .\ne:c e:p 1 .\n@prefix e: <http://f/> .\ne:c e:p 2 .\n",
        "old": "PREFIX e: <http://e/>\nBASE <http://base/>\ne:d e:p <here> .\ne:d e:p e:x.\n\n  \n",
        "empty": "\n# nothing.\n",
        "other": "@prefix e: <http://other/> .\ne:z e:p 1 .\n# the end",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.ttl").write_text(text)
    want = sorted((s, p, o) for t in texts.values() for s, p, o, _ in parse(t))
    assert len(want) == 7
    assert _bare(files.read_turtle(spark, str(tmp_path))) == want
    (tmp_path / "bad.ttl").write_text("x:a x:b x:c .\n")
    with pytest.raises(ValueError, match="bad.ttl"):
        files.read_turtle(spark, str(tmp_path))


def test_round_trips(spark, table, tmp_path):  # noqa: F811
    assert files.round_trips(table(fact("a", objects=["@x", 1, 2.5, True, "t"], attributes={"k": "v"}), fact("b")), str(tmp_path))


@pytest.mark.parametrize("name", sorted(generators.GENERATORS))
def test_generators_repeat_themselves(spark, name):
    a, b = files.load(spark, name), files.load(spark, name)
    assert a.count() > 10 and a.exceptAll(b).isEmpty() and a.select("fact_id").distinct().count() == a.count()


def test_synthetic_shape(spark):
    f = generators.synthetic(spark, 2000)
    r = f.selectExpr("min(size(objects)) a", "max(size(objects)) b", "avg(cast(valid_start is not null as double)) t", "count(distinct subject) s").first()
    assert (r.a, r.b) == (3, 8) and 0.35 < r.t < 0.45 and r.s > 20
    assert generators.context_tree(spark, 2, 3).count() == 2 + 3 + 9


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), ("50%", None)], "k string, n int")
    for form in ("csv", "json", "parquet", "markdown", "latex"):
        files.write_result(df, str(tmp_path / form), form)
    assert "a\\|b" in "".join(r.value for r in spark.read.text(str(tmp_path / "markdown")).collect())
    assert r"50\%" in "".join(r.value for r in spark.read.text(str(tmp_path / "latex")).collect())
    with pytest.raises(ValueError):
        files.write_result(df, str(tmp_path / "x"), "markdown", most=1)


def test_stream(spark, table, tmp_path):  # noqa: F811
    src = str(tmp_path / "in")
    table(fact("a"), fact("a"), fact("b", confidence=7.0), fact("c")).coalesce(1).write.json(src)
    q = ingest.append(ingest.once(ingest.valid(ingest.read(spark, src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.fact_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
