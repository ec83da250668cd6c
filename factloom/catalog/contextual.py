"""Context algebra, topology, gluing, consistency, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.registry import DOCS, EVENTS, LINES, ORDERS, PLACES, query
from factloom.functions import contexts as C
from factloom.functions import values as V
from factloom.functions import temporal
from factloom.functions.staging import cut
from factloom.operators import gluing, incremental, intervals, poset, topology, validate, workloads
from factloom.sources import tables as T

_CTX = f"{ORDERS}, {EVENTS}, c0 as (select distinct context from orders_f union select distinct context from events_f), ctx as (select distinct array_to_string(list_slice(string_split(context, '.'), 1, k), '.') as context from c0, (values (1), (2), (3)) v(k))"


def _contexts(s, d):
    return poset.contexts(T.order_facts(s, d).select("context").union(T.event_facts(s, d).select("context")).distinct())


@query("ctx_ancestors", f"with {ORDERS}, c as (select distinct context from orders_f) select context, array_to_string(list_slice(string_split(context, '.'), 1, k), '.') as ancestor from c, (values (1), (2), (3)) v(k)")
def ctx_ancestors(s, d):
    return T.order_facts(s, d).select("context").distinct().select("context", F.explode(C.ancestors(F.col("context"))).alias("ancestor"))


@query("ctx_poset", f"with {_CTX} select context, cast(len(string_split(context, '.')) as int) as depth, case when len(string_split(context, '.')) > 1 then array_to_string(list_slice(string_split(context, '.'), 1, len(string_split(context, '.')) - 1), '.') end as parent from ctx")
def ctx_poset(s, d):
    return _contexts(s, d)


_LATTICE = """, p as (select a.context as a, b.context as b, string_split(a.context, '.') as x, string_split(b.context, '.') as y from ctx a, ctx b where a.context < b.context),
    q as (select a, b, array_to_string([x[i] for i in range(1, 4) if i <= len(x) and i <= len(y) and x[1:i] = y[1:i]], '.') as common, a = b or starts_with(a, b || '.') or starts_with(b, a || '.') as cmp,
          case when length(a) >= length(b) then a else b end as narrow, case when length(a) >= length(b) then b else a end as broad from p)"""


@query("ctx_meet_join", f"with {_CTX}{_LATTICE} select a, b, case when common = '' then 'world' else common end as path_meet, case when cmp then broad else 'world' end as path_join, case when cmp then narrow when common = '' then 'world' else common end as poset_meet, nullif(common, '') as poset_join from q")
def ctx_meet_join(s, d):
    c = _contexts(s, d).select("context")
    pairs = c.select(F.col("context").alias("a")).join(c.select(F.col("context").alias("b")), F.col("a") < F.col("b"))
    return poset.lattice(pairs)


@query("ctx_cover", f"with {_CTX} select p.context as context, c.context as child from ctx p, ctx c where starts_with(c.context, p.context || '.') and not exists (select 1 from ctx m where starts_with(c.context, m.context || '.') and starts_with(m.context, p.context || '.'))")
def ctx_cover(s, d):
    return poset.cover(_contexts(s, d))


@query("ctx_leaves", f"with {_CTX} select context from ctx a where not exists (select 1 from ctx b where starts_with(b.context, a.context || '.'))")
def ctx_leaves(s, d):
    return poset.leaves(_contexts(s, d))


@query("ctx_root", f"with {_CTX} select context from ctx order by len(string_split(context, '.')), context limit 1")
def ctx_root(s, d):
    return poset.root(_contexts(s, d))


@query("ctx_visible_facts", f"with {LINES} select fact_id, t as context from lines_f, (values ('world.1996.03', 'world.1996'), ('world.1997', 'world.1997')) v(t, c) where context = c")
def ctx_visible_facts(s, d):
    targets = s.createDataFrame([("world.1996.03",), ("world.1997",)], "target string")
    return poset.visible(T.lineitem_facts(s, d), targets).select("fact_id", "context")


_SETS = f"""{ORDERS}, m as (
    select distinct 'event:' || fact_id as open_set, 'event' as kind, fact_id from orders_f
    union select 'entity:' || subject, 'entity', fact_id from orders_f union select 'entity:' || obj0, 'entity', fact_id from orders_f
    union select 'temporal:' || year(vs), 'temporal', fact_id from orders_f
    union select 'context:world', 'context', fact_id from orders_f union select 'context:world.' || year(vs), 'context', fact_id from orders_f union select 'context:' || context, 'context', fact_id from orders_f
    union select 'source:' || source, 'source', fact_id from orders_f union select 'method:' || method, 'method', fact_id from orders_f)"""


@query("open_set_sizes", f"with {_SETS} select kind, open_set, count(*) as n_facts from m group by 1, 2")
def open_set_sizes(s, d):
    return topology.sizes(topology.members(T.order_facts(s, d), versions=False))


@query("minimal_open_set", f"with {_SETS}, z as (select open_set, count(*) as n from m group by 1), r as (select fact_id, open_set, n, row_number() over (partition by fact_id order by n, encode(open_set)) as k from m join z using (open_set)) select fact_id, open_set, n as n_facts from r where k = 1")
def minimal_open_set(s, d):
    return topology.minimal_open_set(topology.members(T.order_facts(s, d), versions=False))


@query("restriction_sections", f"with {ORDERS} select fact_id from orders_f where context like 'world.1996%' and method = 'manual'")
def restriction_sections(s, d):
    f = T.order_facts(s, d)
    return topology.restrict(topology.members(f, ("context", "provenance")), f, "context:world.1996", "method:manual").select("fact_id")


@query("restriction_edges", f"""with {_SETS}, k as (select * from m where kind in ('context', 'temporal')), z as (select open_set, count(*) as n from k group by 1),
    p as (select a.open_set as source, b.open_set as target, count(*) as c from k a join k b using (fact_id) where a.open_set <> b.open_set group by 1, 2) select source, target from p join z on z.open_set = p.target where c = n""")
def restriction_edges(s, d):
    return topology.restriction_edges(topology.members(T.order_facts(s, d), ("context", "temporal"), versions=False))


_CLOSED = f"""{PLACES}, e as (select fact_id, subject as ent from places_f union select fact_id, obj0 from places_f), z as (select ent, count(*) as n, min(fact_id) as f from e group by ent),
    w as (select e.* from e join z using (ent) where n > 1), p as (select 'entity:' || a.ent || '&entity:' || b.ent as name, min(fact_id) as f, count(*) as n from w a join w b using (fact_id) where a.ent < b.ent group by 1),
    one as (select f, arg_min(name, row(length(name), name)) as name from (select 'entity:' || ent as name, f from z where n = 1 union all select name, f from p where n = 1) group by f)"""


@query("intersection_closure", f"with {_CLOSED} select 'context:world' as open_set, count(*)::int as n from places_f union all select 'entity:' || ent, n::int from z where n > 1 union all select name, n::int from p where n > 1 union all select name, 1 from one")
def intersection_closure(s, d):
    closed = topology.closed_members(topology.members(T.place_facts(s, d), ("entity", "context")))
    return closed.groupBy("open_set").agg(F.count("*").cast("int").alias("n"))


@query("neighborhood_sets", f"with {PLACES} select 'neighborhood:' || obj0 as open_set, count(*) as n_facts from places_f group by 1")
def neighborhood_sets(s, d):
    return topology.sizes(topology.members(T.place_facts(s, d), ("neighborhood",), versions=False)).select("open_set", "n_facts")


_GLUE = f"""{DOCS}, g as (select fact_id, count(*) as n, min(lang) as lang, max(confidence) as confidence, count(distinct source) as ns, count(distinct lang) as nl, min(source) as source,
    max(quality) as quality, max(seq) as seq, arg_max(prov, seq) filter (prov <> 'unknown') as prov from docs_f group by fact_id having count(*) >= 2)"""


@query("glue_global", f"with {_GLUE} select fact_id, lang, confidence, source, cast(quality as bigint) as quality, prov, 'world' as context from g where ns <= 1 and nl <= 1")
def glue_global(s, d):
    g = gluing.global_sections(T.document_facts(s, d))
    a = F.col("attributes")
    return g.select("fact_id", F.get("objects", F.lit(0))["str"].alias("lang"), "confidence", V.attribute(a, "source")["str"].alias("source"), V.attribute(a, "quality")["lng"].alias("quality"), F.col("provenance.source").alias("prov"), "context")


@query("glue_conflicts", f"with {_GLUE} select fact_id, n as n_sections, case when nl > 1 then 'objects' else 'attribute' end as reason from g where ns > 1 or nl > 1")
def glue_conflicts(s, d):
    return gluing.conflicts(T.document_facts(s, d))


@query("glue_cover", f"with {DOCS} select fact_id, 'world.corpus' as context, count(distinct coalesce('=' || source, '') || coalesce('=' || lang, '')) = 1 as agrees from docs_f group by fact_id")
def glue_cover(s, d):
    """Labels lie within the corpus here, and both say where a document is from; some disagree."""
    f = T.document_facts(s, d).withColumn("attributes", F.filter("attributes", lambda a: a["key"] == "source"))
    nested = f.withColumn("context", F.when(F.col("context") == "world.labels", "world.corpus.labels").otherwise(F.col("context")))
    return gluing.glue_cover(nested, "world.corpus").select("fact_id", "context", "agrees")


def _assignments(s, d):
    f = T.document_facts(s, d)
    return f.select("context", F.col("subject").alias("entity"), V.attribute(F.col("attributes"), "source")["str"].alias("value"))


@query("consistency_check", f"with {DOCS}, e as (select fact_id, count(distinct source) as n from docs_f group by 1) select count(*) as n_entities, count(*) filter (n > 1) as n_inconsistent, max(n) as max_values from e")
def consistency_check(s, d):
    return workloads.consistency(_assignments(s, d))


@query("global_section", f"with {DOCS} select fact_id as entity, min(source) as value from docs_f group by 1 having count(distinct source) = 1")
def global_section(s, d):
    return workloads.global_section(_assignments(s, d))


@query("local_equivalence", f"with {DOCS} select a.fact_id, a.source = b.source and b.quality is null as equal from docs_f a join docs_f b on a.fact_id = b.fact_id where a.context = 'world.corpus' and b.context = 'world.labels'")
def local_equivalence(s, d):
    f = T.document_facts(s, d)
    return gluing.locally_equal(f.where("context = 'world.corpus'"), f.where("context = 'world.labels'"))


@query("validate_invariants", "select 'event/' || event_id as fact_id, 'confidence is not within 0 and 1' as message from events where value > 100 union all select 'event/' || event_id, 'interval ends before it starts' from events where user_id % 50 = 0")
def validate_invariants(s, d):
    e = T.event_facts(s, d)
    user = F.substring_index("subject", "/", -1).cast("long")
    broken = e.withColumn("confidence", F.when(V.as_number(F.get("objects", F.lit(0))) > 100, 1.5).otherwise(F.col("confidence")))
    broken = broken.withColumn("valid_end", F.when(user % 50 == 0, F.col("valid_start") - F.expr("interval 1 hour")).otherwise(F.col("valid_end")))
    return validate.invariants(broken)


@query("duplicate_ids", f"with {DOCS} select fact_id, count(*) as n from docs_f group by 1 having count(*) > 1")
def duplicate_ids(s, d):
    return validate.duplicates(T.document_facts(s, d))


@query("dangling_references", f"with {LINES} select fact_id, obj0 as ref from lines_f where obj0 not in (select 'part/' || p_partkey from part where p_size > 2)")
def dangling_references(s, d):
    part = T.read(s, d, "part").where("p_size > 2").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("entity"))
    supplier = T.read(s, d, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("entity"))
    return validate.dangling(T.lineitem_facts(s, d), part.union(supplier))


@query("axioms_of_nested_contexts", f"""with {_SETS}, k as (select open_set as low, fact_id, regexp_replace(open_set, '\\.[^.]*$', '') as mid from m where kind = 'context' and open_set like '%.%'),
    c as (select *, regexp_replace(mid, '\\.[^.]*$', '') as top from k where mid like '%.%')
    select 'identity' as axiom, (select count(*) from m a where not exists (select 1 from m b where b.open_set = a.open_set and b.fact_id = a.fact_id)) as violations
    union all select 'composition', (select count(*) from c where exists (select 1 from m where open_set = top and m.fact_id = c.fact_id) and not exists (select 1 from m where open_set = mid and m.fact_id = c.fact_id))""")
def axioms_of_nested_contexts(s, d):
    f = T.order_facts(s, d)
    return topology.axiom_report(f, topology.members(f)).where("axiom in ('identity', 'composition')")


@query("axiom_report", f"with {_GLUE} select 'gluing' as axiom, (select count(*) from (select fact_id from docs_f group by 1 having count(*) > 1)) as violations union all select 'locality', (select count(*) from (select fact_id from docs_f group by 1 having count(*) > 1)) union all select 'identity', 0 union all select 'composition', 0 union all select 'known points', 0")
def axiom_report(s, d):
    f = T.document_facts(s, d)
    return topology.axiom_report(f, topology.members(f, ("event", "context")))


_WINDOWS = """win as (select 'supplier/' || s_suppkey as w, timestamp '1995-01-01' + to_days(cast(s_suppkey * 37 % 1500 as int)) as a, timestamp '1995-01-01' + to_days(cast(s_suppkey * 37 % 1500 + 20 * (s_suppkey % 9) as int)) as b from supplier
    union all select 'all', timestamp '1990-01-01', timestamp '2010-01-01' union all select 'open', timestamp '1998-01-01', null)"""


@query(
    "interval_join",
    f"""with {ORDERS}, {_WINDOWS}, p as (select w, fact_id, greatest(vs, a) as lo, least(ve, coalesce(b, ve)) as hi from orders_f join win on vs < coalesce(b, timestamp '9999-01-01') and a < ve and (b is null or a < b))
    select w, count(*) as n, sum(epoch_us(hi) - epoch_us(lo))::bigint as overlap_us, min(fact_id) as first_fact from p group by w""",
)
def interval_join(s, d):
    """Order facts with the suppliers' windows, which overlap each other, one over all times and one without an end.

    Sums are the bigint of its SQL where all of them fit it; of millions of orders some do not, and all are decimals.
    """
    f = T.order_facts(s, d)
    begin = lambda days: F.expr("timestamp_ntz'1995-01-01'") + F.make_dt_interval(days)
    k = F.col("s_suppkey").cast("int")
    own = T.read(s, d, "supplier").select(F.concat(F.lit("supplier/"), k).alias("w"), begin(k * 37 % 1500).alias("a"), begin(k * 37 % 1500 + 20 * (k % 9)).alias("b"))
    windows = own.union(s.sql("select 'all', timestamp_ntz'1990-01-01', timestamp_ntz'2010-01-01' union all select 'open', timestamp_ntz'1998-01-01', null"))
    found = cut(intervals.overlap_totals(f, windows, "fact_id", "w", ("valid_start", "valid_end"), ("a", "b")), "totals")
    most = found.agg(F.max("overlap_us")).first()[0] or 0
    total = F.col("overlap_us").cast("long" if most < 1 << 63 else "decimal(38,0)")
    return found.select("w", "n", total.alias("overlap_us"), F.col("first").alias("first_fact"))


@query(
    "topology_followed",
    f"""with {ORDERS}, f as (select fact_id, context, case when seq % 11 = 0 then year(vs) + 1 else year(vs) end as y from orders_f where seq % 13 <> 0),
    m as (select fact_id, 'temporal:' || y as o from f union all select fact_id, 'context:world' from f union all select fact_id, 'context:' || context from f
          union all select fact_id, 'context:' || split_part(context, '.', 1) || '.' || split_part(context, '.', 2) from f),
    n as (select o, count(*) as n from m group by o), p as (select a.o as source, b.o as target, count(*) as c from m a join m b using (fact_id) where a.o <> b.o group by all)
    select 'size' as part, o as source, '' as target, n from n union all select 'edge', source, target, n from p join n on n.o = target and c = n""",
)
def topology_followed(s, d):
    """Open sets and restriction edges of order facts after an insert, an update and a delete, each by its change alone."""
    f = T.order_facts(s, d)
    t = incremental.Topology.build(f.where("seq % 5 <> 0"), ("temporal", "context"))
    t = t.changed(f.where("seq % 5 = 0"), f.where("seq % 5 = 0"))
    later = f.where("seq % 11 = 0").withColumn("valid_start", F.col("valid_start") + F.expr("interval 1 year"))
    t = t.changed(later, later)
    t = t.changed(f.where("seq % 13 = 0"), f.limit(0))
    edges = t.edges().join(t.sizes.select(F.col("open_set").alias("target"), "n"), "target").select(F.lit("edge").alias("part"), "source", "target", "n")
    return t.sizes.select(F.lit("size").alias("part"), F.col("open_set").alias("source"), F.lit("").alias("target"), "n").unionByName(edges)
