"""The canonical layer, temporal index paths and serialisation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from factloom.catalog.registry import DOCS, LINES, ORDERS, PLACES, STATEMENTS, query
from factloom.catalog.joins import statements
from factloom.functions import contexts as C
from factloom.functions import temporal
from factloom.functions import values as V
from factloom.operators import canonical, triples
from factloom.plans import templates
from factloom.sources import files
from factloom.sources import tables as T


@query("canonical_entities", f"with {PLACES}, e as (select distinct fact_id, subject as entity from places_f union select distinct fact_id, obj0 from places_f) select entity, split_part(entity, '/', 1) as kind, count(*) as n_facts from e group by entity")
def canonical_entities(s, d):
    return canonical.entities(T.place_facts(s, d))


@query("canonical_relations", f"with {ORDERS}, {LINES} select 'placed_order' as relation, 3 as arity, 'ref,float,str' as slots, count(*) as n_facts from orders_f union all select 'shipped', 5, 'ref,ref,float,float,str', count(*) from lines_f")
def canonical_relations(s, d):
    return canonical.relations(T.order_facts(s, d).unionByName(T.lineitem_facts(s, d)))


@query("canonical_described", f"with {PLACES} select fact_id, subject, case when starts_with(subject, 'nation/') then 'nation' else 'UNKNOWN' end as subject_kind, true as conforms from places_f")
def canonical_described(s, d):
    f = T.place_facts(s, d)
    known = canonical.entities(f).where("kind = 'nation'")
    return canonical.described(f, known, canonical.relations(f)).select("fact_id", "subject", "subject_kind", "conforms")


@query("temporal_ends_after", f"with {ORDERS} select fact_id from orders_f where ve > timestamp '1998-06-01'")
def temporal_ends_after(s, d):
    f = T.order_facts(s, d)
    return f.where(temporal.ends_after(F.col("valid_start"), F.col("valid_end"), datetime(1998, 6, 1))).select("fact_id")


@query("temporal_starts_before", f"with {ORDERS} select fact_id from orders_f where vs < timestamp '1995-04-01'")
def temporal_starts_before(s, d):
    return T.order_facts(s, d).where(temporal.starts_before(F.col("valid_start"), datetime(1995, 4, 1))).select("fact_id")


@query("temporal_buckets", f"with {ORDERS}, {DOCS} select cast(year(vs) as varchar) as bucket, count(*) as n from orders_f group by 1 union all select 'atemporal', count(*) from docs_f")
def temporal_buckets(s, d):
    f = T.order_facts(s, d).unionByName(T.document_facts(s, d))
    return f.groupBy(temporal.bucket(F.col("valid_start")).alias("bucket")).agg(F.count("*").alias("n"))


@query("context_restriction", f"with {LINES} select fact_id, case when context = 'world.1996' then 'world.1996.03' end as restricted from lines_f")
def context_restriction(s, d):
    return T.lineitem_facts(s, d).select("fact_id", C.restrict(F.col("context"), "world.1996.03").alias("restricted"))


@query("json_round_trip", f"with {ORDERS} select fact_id, subject, context, num1, status, source, vs, ve from orders_f")
def json_round_trip(s, d):
    f = files.from_json(files.to_json(T.order_facts(s, d)))
    return f.select("fact_id", "subject", "context", F.get("objects", F.lit(1))["dbl"].alias("num1"), V.attribute(F.col("attributes"), "status")["str"].alias("status"), "provenance.source", F.col("valid_start").alias("vs"), F.col("valid_end").alias("ve"))


@query("edges", f"with {LINES} select subject as src, obj0 as dst, 0 as pos from lines_f union all select subject, obj1, 1 from lines_f")
def edges(s, d):
    return triples.edges(T.lineitem_facts(s, d)).select("src", "dst", "pos")


@query("template_two_hops", f"with {STATEMENTS} select a.s, b.o as z from st a join st b on a.o = b.s where a.p = 'located_in' and b.p = 'located_in'")
def template_two_hops(s, d):
    return templates.run(statements(s, d), "two_hops", relation="located_in", next="located_in")


@query("template_count_by_object", f"with {STATEMENTS} select o, count(*) as n from st where p = 'located_in' group by o having count(*) > 4")
def template_count_by_object(s, d):
    return templates.run(statements(s, d), "count_by_object", relation="located_in", least=4)
