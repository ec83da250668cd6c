"""Queries through the two text front ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.joins import statements
from factloom.catalog.registry import LINES, ORDERS, PLACES, STATEMENTS, query
from factloom.operators import triples
from factloom.plans import language, sparql
from factloom.sources import tables as T


def _sparql(name: str, text: str, sql: str, numbers: tuple[str, ...] = ()) -> None:
    query(name, f"with {STATEMENTS} {sql}")(lambda s, d: sparql.run(statements(s, d), text, numbers=numbers))


_sparql("sparql_one_pattern", "SELECT ?c WHERE { ?c located_in nation/5 . }", "select s as c from st where p = 'located_in' and o = 'nation/5'")
_sparql("sparql_distinct", "SELECT DISTINCT ?n WHERE { ?c located_in ?n }", "select distinct o as n from st where p = 'located_in'")
_sparql("sparql_two_patterns", "SELECT ?c ?st WHERE { ?c located_in nation/5 . ?c status ?st }", "select a.s as c, b.o as st from st a join st b on a.s = b.s where a.p = 'located_in' and a.o = 'nation/5' and b.p = 'status'")
_sparql("sparql_range_filter", "SELECT ?c ?v WHERE { ?c placed_order ?v FILTER(?v >= 400000) }", "select s as c, num as v from st where p = 'placed_order' and num >= 400000", ("v",))
_sparql("sparql_predicate_list", "SELECT ?c ?st WHERE { ?c located_in nation/7 ; status ?st . FILTER(?st = 'F' || ?st = 'P') }", "select a.s as c, b.o as st from st a join st b on a.s = b.s where a.p = 'located_in' and a.o = 'nation/7' and b.p = 'status' and b.o in ('F', 'P')")
_sparql("sparql_count", "SELECT (COUNT(*) AS ?n) WHERE { ?c located_in ?x }", "select count(*) as n from st where p = 'located_in'")
_sparql("sparql_avg", "SELECT (AVG(?v) AS ?mean) WHERE { ?c placed_order ?v }", "select avg(num) as mean from st where p = 'placed_order'")
_sparql("sparql_group_having", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c located_in ?n } GROUP BY ?n HAVING(?k > 50)", "select o as n, count(*) as k from st where p = 'located_in' group by o having count(*) > 50")
_sparql("sparql_count_distinct", "SELECT ?p (COUNT(DISTINCT ?s) AS ?k) WHERE { ?s ?p ?o } GROUP BY ?p", "select p, count(distinct s) as k from st group by p")
_sparql("sparql_order_limit", "SELECT ?c ?v WHERE { ?c placed_order ?v FILTER(?v > 0) } ORDER BY DESC(?v) LIMIT 10", "select s as c, num as v from st where p = 'placed_order' and num > 0 order by num desc limit 10", ("v",))
_sparql("sparql_join_order_limit", "SELECT ?c ?v WHERE { ?c located_in nation/3 . ?c placed_order ?v FILTER(?v > 1) } ORDER BY ?v LIMIT 5 OFFSET 2", "select a.s as c, b.num as v from st a join st b on a.s = b.s where a.p = 'located_in' and a.o = 'nation/3' and b.p = 'placed_order' and b.num > 1 order by b.num limit 5 offset 2", ("v",))
_sparql("sparql_three_patterns", "SELECT ?c ?r WHERE { ?c status 'P' . ?c located_in ?n . ?n located_in ?r FILTER(?r != 'region/0') }", "select a.s as c, r.o as r from st a join st n on a.s = n.s join st r on n.o = r.s where a.p = 'status' and a.o = 'P' and n.p = 'located_in' and r.p = 'located_in' and r.o <> 'region/0'")
_sparql("sparql_union", "SELECT ?x WHERE { { ?x located_in region/1 } UNION { ?x located_in region/2 } }", "select s as x from st where p = 'located_in' and o in ('region/1', 'region/2')")
_sparql("sparql_optional", "SELECT ?n ?r WHERE { ?n located_in region/4 OPTIONAL { ?n status ?r } }", "select s as n, null::varchar as r from st where p = 'located_in' and o = 'region/4'")
_sparql("sparql_all_variables", "SELECT * WHERE { ?a located_in ?b FILTER(?b = 'region/3') }", "select s as a, o as b from st where p = 'located_in' and o = 'region/3'")


def _lang(name: str, text: str, ctes: str, sql: str, tables) -> None:
    query(name, f"with {ctes} {sql}")(lambda s, d: language.run(text, {k: f(s, d) for k, f in tables.items()}))


_O, _L, _P = {"facts": T.order_facts}, {"facts": T.lineitem_facts}, {"facts": T.place_facts}
_lang("lang_select", "SELECT ?f, ?f.subject, ?f.status AS status FROM facts ?f WHERE ?f.arg1 > 350000 AND ?f.status != 'F'", ORDERS, "select fact_id as f, subject as f_subject, status from orders_f where num1 > 350000 and status <> 'F'", _O)
_lang("lang_predicates", "SELECT ?f FROM facts ?f CONTEXT(?f, 'world.1996') TEMPORAL(?f, '1996-02-01', '1996-03-01') PROVENANCE(?f, '5-LOW')", ORDERS, "select fact_id as f from orders_f where starts_with(context, 'world.1996.') and vs < timestamp '1996-03-01' and ve > timestamp '1996-02-01' and source = '5-LOW'", _O)
_lang("lang_neighborhood", "SELECT ?f FROM facts ?f NEIGHBORHOOD(?f, 'nation/4')", PLACES, "select fact_id as f from places_f where subject = 'nation/4' or obj0 = 'nation/4'", _P)
_lang("lang_group", "SELECT ?f.status AS status, COUNT(*) AS n, MAX(?f.arg1) AS top FROM facts ?f WHERE ?f.confidence >= 0.5 GROUP BY ?f.status HAVING n > 10", ORDERS, "select status, count(*) as n, max(num1) as top from orders_f where confidence >= 0.5 group by status having count(*) > 10", _O)
_lang("lang_union", "SELECT ?f.subject AS x FROM facts ?f WHERE ?f.arg0 = 'region/1' UNION SELECT ?f.arg0 AS x FROM facts ?f WHERE ?f.subject = 'nation/1'", PLACES, "select subject as x from places_f where obj0 = 'region/1' union select obj0 from places_f where subject = 'nation/1'", _P)
_lang("lang_distinct", "SELECT DISTINCT ?f.arg4 AS flag, ?f.context AS ctx FROM facts ?f", LINES, "select distinct obj4 as flag, context as ctx from lines_f", _L)
_lang("lang_in_not", "SELECT ?f FROM facts ?f WHERE NOT ?f.status IN ('F', 'O') AND ?f.subject IS NOT NULL", ORDERS, "select fact_id as f from orders_f where status not in ('F', 'O')", _O)
_lang("lang_join", "SELECT ?a.subject AS c, ?b.arg0 AS r FROM facts ?a JOIN facts ?b ON ?a.arg0 = ?b.subject", PLACES, "select a.subject as c, b.obj0 as r from places_f a join places_f b on a.obj0 = b.subject", _P)
_lang("lang_optional", "SELECT ?a AS a, ?b AS b FROM facts ?a OPTIONAL facts ?b ON ?a.arg0 = ?b.subject", PLACES, "select a.fact_id as a, b.fact_id as b from places_f a left join places_f b on a.obj0 = b.subject", _P)
_lang("lang_order", "SELECT ?f AS f, ?f.arg0 AS o FROM facts ?f ORDER BY f DESC LIMIT 20 OFFSET 3", ORDERS, "select fact_id as f, obj0 as o from orders_f order by encode(fact_id) desc limit 20 offset 3", _O)


@query("pattern_fallbacks", f"with {PLACES} select subject as s from places_f where obj0 = 'nation/0'")
def pattern_fallbacks(s, d):
    return triples.match(triples.statements(T.place_facts(s, d)), o="nation/0").select(F.col("s"))
