"""``query`` registers, and the SQL forms of the facts that the driver's tables give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = """orders_f as (
    select 'order/' || o_orderkey as fact_id, 'customer/' || o_custkey as subject, 'placed_order' as relation,
           'order/' || o_orderkey as obj0, o_totalprice as num1, o_orderpriority as obj2, o_orderstatus as status,
           'world.' || year(o_orderdate) || '.' || o_orderstatus as context, (o_orderkey % 100) / 100.0::double as confidence,
           o_orderpriority as source, case when o_orderkey % 2 = 0 then 'import' else 'manual' end as method,
           o_orderdate as vs, o_orderdate + interval 30 day as ve, o_orderkey as seq
    from orders)"""
LINES = """lines_f as (
    select 'line/' || l_orderkey || '/' || l_linenumber as fact_id, 'order/' || l_orderkey as subject, 'shipped' as relation,
           'part/' || l_partkey as obj0, 'supplier/' || l_suppkey as obj1, l_quantity as num2, l_extendedprice as num3, l_returnflag as obj4,
           'world.' || year(l_shipdate) as context, 1.0::double as confidence, l_shipdate as vs, l_shipdate + interval 1 day as ve
    from lineitem)"""
EVENTS = """events_f as (
    select 'event/' || event_id as fact_id, 'user/' || user_id as subject, event_type as relation, value as num0,
           'world.events.' || event_type as context, 1.0::double as confidence, ts as vs, ts + interval 1 hour as ve
    from events)"""
PLACES = """places_f as (
    select 'place/customer/' || c_custkey as fact_id, 'customer/' || c_custkey as subject, 'located_in' as relation, 'nation/' || c_nationkey as obj0 from customer
    union all select 'place/supplier/' || s_suppkey, 'supplier/' || s_suppkey, 'located_in', 'nation/' || s_nationkey from supplier
    union all select 'place/nation/' || n_nationkey, 'nation/' || n_nationkey, 'located_in', 'region/' || n_regionkey from nation)"""
DOCS = """docs_f as (
    select 'doc/' || doc_id as fact_id, lang, source, null::bigint as quality, 0.5::double as confidence, 'world.corpus' as context, source as prov, doc_id * 2 as seq from documents
    union all
    select 'doc/' || d.doc_id, d.lang, case when d.doc_id % 7 = 0 then 'elsewhere' else d.source end, l.quality, 0.9::double, 'world.labels', 'unknown', d.doc_id * 2 + 1
    from labels l join documents d using (doc_id))"""
#: (s, p, o, num) of order, line and place facts.
STATEMENTS = f"""{ORDERS}, {LINES}, {PLACES}, st as (
    select subject as s, relation as p, obj0 as o, null::double as num, fact_id from orders_f
    union all select subject, relation, null, num1, fact_id from orders_f
    union all select subject, relation, obj2, null, fact_id from orders_f
    union all select subject, 'status', status, null, fact_id from orders_f
    union all select subject, relation, obj0, null, fact_id from lines_f
    union all select subject, relation, obj1, null, fact_id from lines_f
    union all select subject, relation, null, num2, fact_id from lines_f
    union all select subject, relation, null, num3, fact_id from lines_f
    union all select subject, relation, obj4, null, fact_id from lines_f
    union all select subject, relation, obj0, null, fact_id from places_f)"""


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with its oracle, if SQL has one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
