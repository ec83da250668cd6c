"""Access paths, typed queries and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.catalog.registry import DOCS, EVENTS, LINES, ORDERS, PLACES, query
from factloom.functions import values as V
from factloom.functions.expressions import compile_expression
from factloom.operators import access
from factloom.operators.access import Kind, Query
from factloom.sources import tables as T

BRIEF = "fact_id, subject, relation, context, confidence"


def brief(df: DataFrame) -> DataFrame:
    return df.select(*BRIEF.split(", "))


def _orders(name: str, where: str, build, columns: str = BRIEF) -> None:
    query(name, f"with {ORDERS} select {columns} from orders_f where {where}")(lambda s, d: brief(build(T.order_facts(s, d))))


_orders("lookup_subject", "subject = 'customer/7'", lambda f: access.run(f, Query(Kind.LOOKUP, subject="customer/7")))
_orders("context_exact", "context = 'world.1996.F'", lambda f: access.in_context(f, "world.1996.F"))
_orders("context_descendants", "context = 'world.1997' or starts_with(context, 'world.1997.')", lambda f: access.run(f, Query(Kind.CONTEXT, context="world.1997")))
_orders("temporal_bounded", "vs < timestamp '1996-03-01' and ve > timestamp '1996-02-01'", lambda f: access.run(f, Query(Kind.TEMPORAL, start="1996-02-01", end="1996-03-01")))
_orders("temporal_bare_year", "vs < timestamp '1996-01-01' and ve > timestamp '1995-01-01'", lambda f: access.run(f, Query(Kind.TEMPORAL, start="1995")))
_orders("temporal_open_start", "vs < timestamp '1995-02-01'", lambda f: access.temporal(f, None, "1995-02-01"))
_orders("temporal_open_end", "ve > timestamp '1998-08-01'", lambda f: access.temporal(f, "1998-08-01", None))
_orders("neighborhood_order", "subject = 'order/44' or obj0 = 'order/44'", lambda f: access.run(f, Query(Kind.NEIGHBORHOOD, subject="order/44")))
_orders("neighborhood_subject_only", "subject = 'customer/11'", lambda f: access.neighborhood(f, "customer/11", subject_only=True))
_orders("provenance_source", "source = '1-URGENT'", lambda f: access.run(f, Query(Kind.PROVENANCE, source="1-URGENT")))
_orders("provenance_method", "method = 'manual'", lambda f: access.by_provenance(f, method="manual"))
_orders("global_scan", "true", lambda f: access.run(f, Query(Kind.GLOBAL)))
_orders("min_confidence", "confidence >= 0.95", lambda f: access.run(f, Query(Kind.GLOBAL, min_confidence=0.95)))
_orders("limit_offset", "true order by fact_id limit 25 offset 10", lambda f: access.run(f, Query(Kind.GLOBAL, limit=25, offset=10)))
_orders("every_field", "subject = 'customer/7' and relation = 'placed_order' and confidence >= 0.2 and vs < timestamp '1999-01-01' and ve > timestamp '1992-01-01'", lambda f: access.run(f, Query(Kind.MIXED, subject="customer/7", relation="placed_order", start="1992-01-01", end="1999-01-01", min_confidence=0.2)))
_orders("objects_filter", "obj0 = 'order/44'", lambda f: access.run(f, Query(Kind.GLOBAL, objects=("order/44",))))


@query("lookup_relation", f"with {EVENTS} select {BRIEF} from events_f where relation = 'click'")
def lookup_relation(s, d):
    return brief(access.by_relation(T.event_facts(s, d), "click"))


@query("context_visible_from", f"with {LINES} select fact_id, subject, relation, 'world.1996.03' as context, confidence from lines_f where context in ('world', 'world.1996', 'world.1996.03')")
def context_visible_from(s, d):
    return brief(access.context_visible_from(T.lineitem_facts(s, d), "world.1996.03"))


@query("neighborhood_mentions", f"with {PLACES} select fact_id, subject from places_f where subject = 'nation/3' or obj0 = 'nation/3'")
def neighborhood_mentions(s, d):
    return access.neighborhood(T.place_facts(s, d), "nation/3").select("fact_id", "subject")


@query("current_versions", f"with {DOCS} select fact_id, max(seq) as seq, arg_max(context, seq) as context from docs_f group by fact_id")
def current_versions(s, d):
    return access.current(T.document_facts(s, d)).select("fact_id", "seq", "context")


@query(
    "context_window_totals",
    f"with {ORDERS} select context, count(*) as n, round(sum(num1), 2) as total from orders_f where (context = 'world.1998' or starts_with(context, 'world.1998.')) and vs < timestamp '1999-01-01' and ve > timestamp '1998-01-01' group by context",
)
def context_window_totals(s, d):
    f = access.run(T.order_facts(s, d), Query(Kind.AGGREGATION, context="world.1998", start="1998"))
    return f.groupBy("context").agg(F.count("*").alias("n"), F.round(F.sum(V.as_number(F.get("objects", F.lit(1)))), 2).alias("total"))


@query("attr_projection", f"with {ORDERS} select fact_id, status from orders_f where status = 'P'")
def attr_projection(s, d):
    f = T.order_facts(s, d).select("fact_id", V.attribute(F.col("attributes"), "status")["str"].alias("status"))
    return f.where("status = 'P'")


@query("object_position", f"with {LINES} select fact_id, obj1, num2 from lines_f where obj1 = 'supplier/5'")
def object_position(s, d):
    f = T.lineitem_facts(s, d).select("fact_id", F.get("objects", F.lit(1))["ref"].alias("obj1"), V.as_number(F.get("objects", F.lit(2))).alias("num2"))
    return f.where("obj1 = 'supplier/5'")


def _expression(name: str, sql: str, text: str) -> None:
    def run(s, d):
        o = T.read(s, d, "orders")
        return o.where(compile_expression(text, {c: F.col(c) for c in o.columns})).select("o_orderkey")

    query(name, f"select o_orderkey from orders where {sql}")(run)


_expression("filter_arith", "o_totalprice * 2 - 1000 > 600000", "o_totalprice * 2 - 1000 > 600000")
_expression("filter_boolean", "(o_orderstatus = 'F' and o_totalprice > 200000) or not (o_custkey < 1400)", "o_orderstatus == 'F' and o_totalprice > 200000 or not o_custkey < 1400")
_expression("filter_chained", "100 <= o_custkey and o_custkey < 200 and o_orderkey <> 5", "100 <= o_custkey < 200 and o_orderkey != 5")
_expression("in_list", "o_orderpriority in ('1-URGENT', '5-LOW')", "o_orderpriority in ['1-URGENT', '5-LOW']")


@query("floor_div_mod", "select o_orderkey, cast(floor((o_orderkey - 500) / 7.0) as bigint) as q, cast((o_orderkey - 500) - 7 * floor((o_orderkey - 500) / 7.0) as bigint) as r from orders")
def floor_div_mod(s, d):
    names = {"k": F.col("o_orderkey")}
    q, r = compile_expression("(k - 500) // 7", names), compile_expression("(k - 500) % 7", names)
    return T.read(s, d, "orders").select("o_orderkey", q.cast("long").alias("q"), r.cast("long").alias("r"))


@query("distinct_projection", f"with {ORDERS} select distinct context, source from orders_f")
def distinct_projection(s, d):
    return T.order_facts(s, d).select("context", F.col("provenance.source").alias("source")).distinct()
