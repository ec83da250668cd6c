"""Reification, pattern joins, algebra joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.registry import EVENTS, LINES, ORDERS, PLACES, STATEMENTS, query
from factloom.functions import values as V
from factloom.operators import access, joins, sets, triples
from factloom.operators.algebra import Filter, Join, Project, Scan, Seek
from factloom.plans import sparql
from factloom.plans.unified import Ask, Form, ask
from factloom.sources import tables as T


def statements(s, d, form=triples.statements):
    """Statements of order, line and place facts."""
    return form(T.order_facts(s, d).unionByName(T.lineitem_facts(s, d)).unionByName(T.place_facts(s, d)))


@query("reify", f"""with {ORDERS}, t as (
    select fact_id as event_id, unnest([{{'p': 'rdf:type', 'pos': 0, 'v': 'rdf:Statement'}}, {{'p': 'rdf:subject', 'pos': 0, 'v': subject}}, {{'p': 'rdf:predicate', 'pos': 0, 'v': relation}},
        {{'p': 'context', 'pos': 0, 'v': context}}, {{'p': 'confidence', 'pos': 0, 'v': 'number'}}, {{'p': 'prov:source', 'pos': 0, 'v': source}}, {{'p': 'prov:recorded_at', 'pos': 0, 'v': null}},
        {{'p': 'prov:confidence', 'pos': 0, 'v': 'number'}}, {{'p': 'prov:method', 'pos': 0, 'v': method}}, {{'p': 'valid_start', 'pos': 0, 'v': 'time'}}, {{'p': 'valid_end', 'pos': 0, 'v': 'time'}},
        {{'p': 'object_', 'pos': 0, 'v': obj0}}, {{'p': 'object_', 'pos': 1, 'v': 'number'}}, {{'p': 'object_', 'pos': 2, 'v': obj2}}, {{'p': 'attr:status', 'pos': 0, 'v': status}}]) as x from orders_f)
    select event_id, x.p as predicate, x.pos as pos, x.v as v from t""")
def reify(s, d):
    t = triples.reify(T.order_facts(s, d))
    v = F.when(V.as_number(F.col("value")).isNotNull(), "number").when(F.col("predicate").startswith("valid_"), "time").otherwise(V.as_text(F.col("value")))
    return t.select("event_id", "predicate", "pos", v.alias("v"))


@query("reify_counts", "select predicate, n from (values ('object_', (select count(*) from events)), ('meta:k', (select count(*) from events where props like '%\"k\"%'))) as t(predicate, n)")
def reify_counts(s, d):
    t = triples.reify(T.event_facts(s, d))
    return t.where(F.col("predicate").isin("object_", "meta:k")).groupBy("predicate").agg(F.count("*").alias("n"))


@query("reconstruct", f"with {ORDERS} select fact_id, subject, relation, context, confidence, obj0, num1, obj2, status, source, method, vs, ve from orders_f")
def reconstruct(s, d):
    f = triples.reconstruct(triples.reify(T.order_facts(s, d)))
    at = lambda k: F.get("objects", F.lit(k))
    return f.select("fact_id", "subject", "relation", "context", "confidence", at(0)["ref"].alias("obj0"), at(1)["dbl"].alias("num1"), at(2)["str"].alias("obj2"), V.attribute(F.col("attributes"), "status")["str"].alias("status"), "provenance.source", "provenance.method", F.col("valid_start").alias("vs"), F.col("valid_end").alias("ve"))


@query("event_scan", f"with {ORDERS} select 15 as n from orders_f where fact_id = 'order/44'")
def event_scan(s, d):
    return triples.scan_event(triples.reify(T.order_facts(s, d)), "order/44").groupBy("event_id").agg(F.count("*").cast("int").alias("n")).select("n")


@query("triple_pattern", f"with {STATEMENTS} select s, o from st where p = 'located_in' and o = 'region/1'")
def triple_pattern(s, d):
    return triples.match(statements(s, d), p="located_in", o="region/1").select("s", "o")


@query("bgp_2", f"with {STATEMENTS} select a.s as c, b.o as r from st a join st b on a.o = b.s where a.p = 'located_in' and b.p = 'located_in'")
def bgp_2(s, d):
    return sparql.run(statements(s, d), "SELECT ?c ?r WHERE { ?c located_in ?n . ?n located_in ?r }")


@query("bgp_3_filter", f"""with {STATEMENTS} select a.s as c, a.o as x, b.num as price from st a join st m on a.s = m.s join st b on a.s = b.s and a.fact_id is not null
    where a.p = 'status' and a.o = 'P' and m.p = 'located_in' and m.o = 'nation/2' and b.p = 'placed_order' and b.num > 300000""")
def bgp_3_filter(s, d):
    text = "SELECT ?c ?x ?price WHERE { ?c status ?x . ?c located_in nation/2 . ?c placed_order ?price FILTER(?price > 300000 && ?x = 'P') }"
    return sparql.run(statements(s, d), text, numbers=("price",))


@query("bgp_optional", f"with {STATEMENTS}, n as (select s, o from st where p = 'located_in'), r as (select s, o from st where p = 'located_in' and o = 'region/2') select n.s as x, n.o as nation, r.o as region from n left join r on n.o = r.s")
def bgp_optional(s, d):
    t = triples.statements(T.place_facts(s, d))
    rows = sparql.run(t, "SELECT ?x ?nation ?r WHERE { ?x located_in ?nation OPTIONAL { ?nation located_in ?r FILTER(?r = 'region/2') } }")
    return rows.select("x", "nation", F.col("r").alias("region"))


@query("entity_pair_join", f"with {PLACES} select fact_id, subject as src, obj0 as dst from places_f where relation = 'located_in' and subject in (select 'nation/' || n_nationkey from nation where n_nationkey < 12) and obj0 in ('region/0', 'region/1')")
def entity_pair_join(s, d):
    nations = T.read(s, d, "nation").where("n_nationkey < 12").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("entity"))
    regions = T.read(s, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("entity"))
    return joins.entity_pairs(triples.edges(T.place_facts(s, d)), nations.union(regions), "located_in").select("fact_id", "src", "dst")


@query("high_arity_lookup", f"with {LINES} select fact_id from lines_f where obj1 = 'supplier/3' and obj4 = 'R' and num2 = 10")
def high_arity_lookup(s, d):
    return joins.high_arity_lookup(T.lineitem_facts(s, d), "shipped", {1: "supplier/3", 4: "R", 2: 10.0}).select("fact_id")


@query("high_arity_join", f"with {LINES} select a.fact_id as left_id, b.fact_id as right_id from lines_f a join lines_f b on a.obj0 = b.obj0 where a.obj4 = 'R' and b.obj4 = 'A'")
def high_arity_join(s, d):
    f = T.lineitem_facts(s, d)
    flag = F.get("objects", F.lit(4))["str"]
    return joins.high_arity_join(f.where(flag == "R"), f.where(flag == "A"), 0, 0)


@query("theta_join", "select n_nationkey, r_regionkey from nation join region on n_regionkey < r_regionkey")
def theta_join(s, d):
    t = {"nation": T.read(s, d, "nation"), "region": T.read(s, d, "region")}
    return Project(Join(Scan("nation"), Scan("region"), condition="n_regionkey < r_regionkey"), ["n_nationkey", "r_regionkey"]).compile(t)


@query("hash_join", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000")
def hash_join(s, d):
    t = {"customer": T.read(s, d, "customer"), "nation": T.read(s, d, "nation")}
    return Project(Join(Filter(Scan("customer"), "c_acctbal > 5000"), Scan("nation"), condition="c_nationkey == n_nationkey"), ["c_custkey", "n_name"]).compile(t)


@query("index_seek", "select o_orderkey, o_totalprice from orders where o_custkey = 7 and o_orderstatus = 'F'")
def index_seek(s, d):
    return Project(Seek("orders", {"o_custkey": 7, "o_orderstatus": "F"}), ["o_orderkey", "o_totalprice"]).compile({"orders": T.read(s, d, "orders")})


@query("semi_restrict", f"with {ORDERS}, {LINES} select fact_id from orders_f where obj0 in (select subject from lines_f where obj4 = 'R' and num2 > 49)")
def semi_restrict(s, d):
    kept = joins.high_arity_lookup(T.lineitem_facts(s, d), "shipped", {4: "R"}).where(V.as_number(F.get("objects", F.lit(2))) > 49)
    return T.order_facts(s, d).join(kept.select(F.col("subject").alias("fact_id")), "fact_id", "left_semi").select("fact_id")


@query("anti_orphans", "select 'customer/' || c_custkey as s from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def anti_orphans(s, d):
    known = T.order_facts(s, d).where(V.as_number(F.get("objects", F.lit(1))) > 250000).select(F.col("subject").alias("term")).distinct()
    return triples.orphans(triples.statements(T.place_facts(s, d)), known).where(F.col("s").startswith("customer/")).select("s").distinct()


@query("dictionary", f"with {PLACES}, t as (select subject as term from places_f union select relation from places_f union select obj0 from places_f) select term, row_number() over (order by encode(term)) - 1 as id from t")
def dictionary(s, d):
    return triples.dictionary(triples.statements(T.place_facts(s, d)))


def _set(name: str, sql: str, build) -> None:
    def run(s, d):
        f = T.order_facts(s, d)
        a, b = access.context_descendants(f, "world.1996"), f.where(F.col("confidence") >= 0.5)
        return build(a.drop("seq"), b.drop("seq"))

    query(name, f"with {ORDERS}, a as (select fact_id from orders_f where context like 'world.1996.%'), b as (select fact_id from orders_f where confidence >= 0.5) {sql}")(run)


_set("union_facts", "select fact_id from a union select fact_id from b", lambda a, b: sets.union(a, b).select("fact_id"))
_set("intersect_facts", "select fact_id from a intersect select fact_id from b", lambda a, b: sets.intersection(a, b).select("fact_id"))
_set("difference_facts", "select fact_id from a except select fact_id from b", lambda a, b: sets.difference(a, b).select("fact_id"))
_set("contained_facts", "select fact_id from a where fact_id in (select fact_id from b)", lambda a, b: sets.contained(a, b).select("fact_id"))


@query("symmetric_diff_count", f"with {ORDERS}, {EVENTS}, a as (select fact_id from orders_f where context like 'world.1996.%'), b as (select fact_id from orders_f where confidence >= 0.5) select (select count(*) from (select * from a except select * from b)) as only_left, (select count(*) from (select * from b except select * from a)) as only_right")
def symmetric_diff_count(s, d):
    f = T.order_facts(s, d)
    left, right = sets.differences(access.context_descendants(f, "world.1996").select("fact_id"), f.where("confidence >= 0.5").select("fact_id"))
    both = left.withColumn("side", F.lit(1)).union(right.withColumn("side", F.lit(2)))
    return both.agg(F.count_if(F.col("side") == 1).alias("only_left"), F.count_if(F.col("side") == 2).alias("only_right"))


@query("concatenate_results", "select n_name as name, n_regionkey as region from nation union all select r_name, null from region")
def concatenate_results(s, d):
    a = T.read(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return sets.concatenate(a, T.read(s, d, "region").select(F.col("r_name").alias("name")))


_ENDS = (*(f"customer/{k}" for k in range(1, 40)), *(f"nation/{k}" for k in range(0, 25, 2)), "region/1")


@query(
    "asked",
    f"""with {PLACES} select 'fact' as form, fact_id from places_f where relation = 'located_in' and obj0 = 'nation/3'
    union all select 'walk', fact_id from places_f where subject = 'customer/7' or subject in (select obj0 from places_f where subject = 'customer/7')
    union all select 'join', fact_id from places_f where subject in {_ENDS!r} and obj0 in {_ENDS!r}
    union all select 'glue', fact_id from places_f""",
)
def asked(s, d):
    """The four forms of pattern query by one entry."""
    f, out = T.place_facts(s, d), None
    asks = (Ask(Form.FACT, relation="located_in", objects=("nation/3",)), Ask(Form.WALK, relation="located_in", entities=("customer/7",), depth=2), Ask(Form.JOIN, relation="located_in", entities=_ENDS), Ask(Form.GLUE, context="world.geo"))
    for a in asks:
        rows = ask(f, a)
        one = (rows.where("agrees") if a.form is Form.GLUE else rows).select(F.lit(a.form.value).alias("form"), "fact_id")
        out = one if out is None else out.unionByName(one)
    return out
