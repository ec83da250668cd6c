"""Aggregation, order, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.joins import statements
from factloom.catalog.registry import EVENTS, ORDERS, STATEMENTS, query
from factloom.functions import values as V
from factloom.operators import stats, workloads
from factloom.operators.algebra import Aggregate, Filter, Limit, Scan, Sort
from factloom.sources import tables as T


def _orders(s, d):
    return {"orders": T.read(s, d, "orders")}


@query("agg_group", "select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, min(o_custkey) as low, max(o_custkey) as high from orders group by 1")
def agg_group(s, d):
    a = Aggregate(Scan("orders"), ["o_orderstatus"], [("COUNT", "*", "n"), ("SUM", "o_totalprice", "total"), ("AVG", "o_totalprice", "mean"), ("MIN", "o_custkey", "low"), ("MAX", "o_custkey", "high")])
    return a.compile(_orders(s, d)).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("agg_global", "select count(*) as n, round(avg(o_totalprice), 4) as mean from orders where o_totalprice > 1000")
def agg_global(s, d):
    return Aggregate(Filter(Scan("orders"), "o_totalprice > 1000"), [], [("COUNT", "*", "n"), ("AVG", "o_totalprice", "mean")]).compile(_orders(s, d)).withColumn("mean", F.round("mean", 4))


@query("count_distinct", f"with {ORDERS} select context, count(distinct subject) as n from orders_f group by context")
def count_distinct(s, d):
    return T.order_facts(s, d).groupBy("context").agg(F.count_distinct("subject").alias("n"))


@query("having", f"with {ORDERS} select subject, count(*) as n from orders_f group by subject having count(*) > 15")
def having(s, d):
    return T.order_facts(s, d).groupBy("subject").agg(F.count("*").alias("n")).where("n > 15")


@query("predicate_frequency", f"with {STATEMENTS} select p, count(*) as n from st group by p")
def predicate_frequency(s, d):
    return stats.predicate_frequency(statements(s, d), "p")


@query(
    "temporal_window_agg",
    f"""with {EVENTS}, w as (select unnest(range(0, 200)) as k), b as (select date '2023-12-25' + 7 * k::int as ws from w)
    select ws as window_start, count(*) as n, round(avg(num0), 6) as mean from b join events_f on vs < ws + 7 and ve > ws group by ws""",
)
def temporal_window_agg(s, d):
    w = workloads.temporal_aggregation(T.event_facts(s, d), "2023-12-25", 7)
    return w.select("window_start", "n", F.round("mean", 6).alias("mean"))


@query("stats_describe", "select count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_pop(o_totalprice), 4) as stddev, min(o_totalprice) as minimum, max(o_totalprice) as maximum, median(o_totalprice) as median from orders")
def stats_describe(s, d):
    t = stats.describe(T.read(s, d, "orders"), "o_totalprice")
    return t.select("n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "minimum", "maximum", "median")


@query(
    "stats_percentiles",
    "with o as (select o_orderstatus, o_totalprice, row_number() over (partition by o_orderstatus order by o_totalprice) - 1 as k, count(*) over (partition by o_orderstatus) as n from orders)"
    " select o_orderstatus, max(o_totalprice) filter (k = least(n - 1, n * 50 // 100)) as p50, max(o_totalprice) filter (k = least(n - 1, n * 95 // 100)) as p95, max(o_totalprice) filter (k = least(n - 1, n * 99 // 100)) as p99 from o group by 1",
)
def stats_percentiles(s, d):
    return stats.ranked(T.read(s, d, "orders"), "o_totalprice", (50, 95, 99), ("o_orderstatus",))


@query("selectivity", "select least(1.0::double, 1.0::double / count(distinct o_custkey)) as selectivity from orders")
def selectivity(s, d):
    return stats.selectivity(T.read(s, d, "orders"), "o_custkey")


@query(
    "storage_stats",
    """with j as (select length('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') as n from customer)
    select count(*) as n_rows, cast(sum(n) as bigint) as json_bytes, sum(n)::double / count(*) as bytes_per_row from j""",
)
def storage_stats(s, d):
    return stats.storage(T.read(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"))


@query("speedup_ratio", "select o_orderstatus, case when sum(case when o_custkey % 10 = 0 then 1 else 0 end) = 0 then 'Infinity'::double else count(*)::double / sum(case when o_custkey % 10 = 0 then 1 else 0 end) end as ratio from orders group by 1")
def speedup_ratio(s, d):
    g = T.read(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("a"), F.count_if(F.col("o_custkey") % 10 == 0).alias("b"))
    return g.select("o_orderstatus", stats.ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("order_multi", "select o_orderkey, o_orderpriority, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 40 offset 5")
def order_multi(s, d):
    plan = Limit(Sort(Scan("orders"), [("o_orderpriority", True), ("o_totalprice", False), ("o_orderkey", True)]), 40, 5)
    return plan.compile(_orders(s, d)).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("topk", f"with {ORDERS} select fact_id, num1 from orders_f order by num1 desc, fact_id limit 10")
def topk(s, d):
    f = T.order_facts(s, d).select("fact_id", V.as_number(F.get("objects", F.lit(1))).alias("num1"))
    return f.orderBy(F.desc("num1"), "fact_id").limit(10)
