"""The contextual workloads as parameterised texts over described facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.registry import ORDERS, query
from factloom.operators import triples
from factloom.plans import templates
from factloom.sources import tables as T

_DAY = "epoch_us({}) // 86400000000"
_DURING = f"{_DAY.format('vs')} < 9800 and {_DAY.format('ve')} > 9700"


def _described(s, d):
    """Order facts about themselves, and what each derives from first."""
    derived = T.derivations(s, d).where("pos = 0").select(F.col("child").alias("s"), F.lit("derived").alias("p"), F.col("parent").alias("o"), F.lit(None).cast("double").alias("num"), F.col("child").alias("fact_id"))
    return triples.described(T.order_facts(s, d)).unionByName(derived)


@query("template_around_entity", f"with {ORDERS} select fact_id as f, 'subject' as p from orders_f where subject = 'customer/7' and confidence >= 0.5")
def template_around_entity(s, d):
    return templates.run(_described(s, d), "around_entity", entity="customer/7", least=0.5)


@query("template_high_arity", f"with {ORDERS} select fact_id as f, obj2 as c from orders_f where obj0 = 'order/44'")
def template_high_arity(s, d):
    return templates.run(_described(s, d), "high_arity", relation="placed_order", first="order/44").select("f", "c")


@query("template_during", f"with {ORDERS} select fact_id as f from orders_f where {_DURING}")
def template_during(s, d):
    return templates.run(_described(s, d), "during", start=9700, end=9800)


@query("template_mean_during", f"with {ORDERS} select count(*) as n, round(avg(num1), 6) as mean from orders_f where {_DURING}")
def template_mean_during(s, d):
    return templates.run(_described(s, d), "mean_during", slot="arg1", start=9700, end=9800).select("n", F.round("mean", 6).alias("mean"))


@query("template_derived", f"with {ORDERS} select fact_id as d, 'order/' || seq // 2 as s, confidence as c from orders_f where seq > 0 and confidence <= 0.25")
def template_derived(s, d):
    return templates.run(_described(s, d), "derived", numbers=("c",), most=0.25)


@query("template_assignments", f"with {ORDERS} select context as x, subject as e, obj2 as v from orders_f")
def template_assignments(s, d):
    return templates.run(_described(s, d), "assignments", slot="arg2")


@query("template_agreed", f"with {ORDERS} select subject as e, obj2 as v, count(distinct context) as n from orders_f group by 1, 2 having count(distinct context) >= 2")
def template_agreed(s, d):
    return templates.run(_described(s, d), "agreed", slot="arg2", least=2)


@query("template_mixed", f"with {ORDERS} select fact_id as n, case when seq > 0 then 'order/' || seq // 2 end as d, case when confidence >= 0.5 then 'true' else 'false' end as sure from orders_f where subject = 'customer/7' and {_DAY.format('vs')} < 10500 and {_DAY.format('ve')} > 9000")
def template_mixed(s, d):
    """Two sub-selects that share a variable, an optional part, and whether something exists."""
    return templates.run(_described(s, d), "mixed", subject="customer/7", start=9000, end=10500, least=0.5)


@query("template_without", f"with {ORDERS} select fact_id as f from orders_f where obj2 <> '5-LOW' and seq > 0")
def template_without(s, d):
    """Facts that do not have a value and do have a part."""
    return templates.run(_described(s, d), "without", relation="placed_order", slot="arg2", value="5-LOW", having="derived")
