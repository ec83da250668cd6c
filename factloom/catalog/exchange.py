"""Files in and out, generators, the store and streams: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog.registry import LINES, ORDERS, PLACES, query
from factloom.functions import values as V
from factloom.functions.staging import scratch
from factloom.operators import triples
from factloom.operators.access import Kind, Query
from factloom.plans.store import FactStore
from factloom.sources import files, generators
from factloom.sources import tables as T
from factloom.streaming import ingest


def _simple(s, d, table, kind, key, above, above_key):
    return T.read(s, d, table).select(
        F.concat(F.lit(f"{kind}/"), key).alias("subject"), F.lit("located_in").alias("relation"), F.array(F.concat(F.lit(f"{above}/"), above_key)).alias("objects"), F.lit("world.geo").alias("context"), F.lit(0.5).alias("confidence")
    )


def _plain(facts):
    first = F.get("objects", F.lit(0))
    return facts.select("subject", "relation", F.coalesce(first["str"], first["ref"]).alias("object"), "context", "confidence")


_NATIONS = "select 'nation/' || n_nationkey as subject, 'located_in' as relation, 'region/' || n_regionkey as object, 'world.geo' as context, 0.5::double as confidence from nation"
_CUSTOMERS = "select 'customer/' || c_custkey as subject, 'located_in' as relation, 'nation/' || c_nationkey as object, 'world.geo' as context, 0.5::double as confidence from customer"


@query("source_json", _NATIONS)
def source_json(s, d):
    """One array in one file, of a table whose size is fixed."""
    path = scratch(s, "json") + "/nations"
    _simple(s, d, "nation", "nation", "n_nationkey", "region", "n_regionkey").agg(F.to_json(F.collect_list(F.struct("subject", "relation", "objects", "context", "confidence")))).write.text(path)
    return _plain(files.read_json(s, path))


@query("source_jsonl", _CUSTOMERS)
def source_jsonl(s, d):
    path = scratch(s, "jsonl") + "/customers"
    _simple(s, d, "customer", "customer", "c_custkey", "nation", "c_nationkey").write.json(path)
    return _plain(files.read_jsonl(s, path))


@query("source_ntriples", "select 'customer/' || c_custkey as subject, 'located_in' as relation, 'nation/' || c_nationkey as object from customer union all select 'customer/' || c_custkey, 'named', c_name from customer")
def source_ntriples(s, d):
    path, c = scratch(s, "nt") + "/customers", T.read(s, d, "customer")
    place = c.select(F.format_string("<customer/%d> <located_in> <nation/%d> .", "c_custkey", "c_nationkey"))
    name = c.select(F.format_string('<customer/%d> <named> "%s"@en .', "c_custkey", "c_name"))
    place.union(name).write.text(path)
    return _plain(files.read_ntriples(s, path)).select("subject", "relation", "object")


_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


@query(
    "source_turtle",
    f"""with c as (select 'http://e/customer/' || c_custkey as s, 'http://e/nation/' || c_nationkey as n, c_name from customer)
    select s as subject, 'http://e/in' as relation, '_' as object from c union all select '_', 'http://e/nation', n from c union all select '_', 'http://e/known', '_' from c union all select '_', 'http://e/name', c_name from c
    union all select s, 'http://e/list', '_' from c union all select '_', '{_RDF}first', '1' from c union all select '_', '{_RDF}rest', '_' from c union all select '_', '{_RDF}first', n from c union all select '_', '{_RDF}rest', '{_RDF}nil' from c""",
)
def source_turtle(s, d):
    """A property list within another and a collection for every customer, each after the prefix, in files of many statements."""
    path, c = scratch(s, "turtle") + "/customers", T.read(s, d, "customer")
    line = F.format_string('PREFIX e: <http://e/>\n<http://e/customer/%d> e:in [ e:nation <http://e/nation/%d> ;\n  e:known [ e:name "%s" ] ] ;\n  e:list ( 1 <http://e/nation/%d> ) .', "c_custkey", "c_nationkey", "c_name", "c_nationkey")
    c.coalesce(2).select(line).write.text(path)
    found = _plain(files.read_turtle(s, path))
    bare = lambda x: F.when(F.col(x).startswith("_:"), "_").otherwise(F.col(x)).alias(x)
    return found.select(bare("subject"), "relation", bare("object"))


@query("source_dispatch", "select 'jsonl' as form, count(*) as n from customer union all select 'parquet', count(*) from customer union all select 'graph', 45")
def source_dispatch(s, d):
    """By ending, by format and by the name of a generator."""
    base, rows = scratch(s, "dispatch"), _simple(s, d, "customer", "customer", "c_custkey", "nation", "c_nationkey")
    rows.write.json(f"{base}/a.jsonl")
    files.load(s, "jsonl", f"{base}/a.jsonl").write.parquet(f"{base}/b.parquet")
    made = {"jsonl": files.load(s, f"{base}/a.jsonl"), "parquet": files.load(s, f"{base}/b.parquet"), "graph": files.load(s, "graph", nodes=10, density=1.0)}
    out = None
    for form, facts in made.items():
        one = facts.agg(F.count("*").alias("n")).select(F.lit(form).alias("form"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("generator_synthetic", "select 2000::bigint as n, 2000::bigint as n_ids, 3 as least_arity, 8 as most_arity, true as in_tree, true as sure, true as timed")
def generator_synthetic(s, d):
    f = generators.synthetic(s, 2000)
    share = F.avg(F.col("valid_start").isNotNull().cast("double"))
    return f.agg(
        F.count("*").alias("n"), F.count_distinct("fact_id").alias("n_ids"), F.min(F.size("objects")).alias("least_arity"), F.max(F.size("objects")).alias("most_arity"),
        F.bool_and(F.col("context").rlike(r"^ctx(\.[0-2]){0,3}$")).alias("in_tree"), F.bool_and(F.col("confidence").between(0.5, 1)).alias("sure"), ((share > 0.35) & (share < 0.45)).alias("timed"),
    )


@query("generator_contexts", "with k as (select unnest(range(0, 3)) as k) select 'world' as context union all select 'ctx' union all select 'ctx.' || a.k from k a union all select 'ctx.' || a.k || '.' || b.k from k a, k b union all select 'ctx.' || a.k || '.' || b.k || '.' || c.k from k a, k b, k c")
def generator_contexts(s, d):
    return generators.context_tree(s)


@query("generator_graph", "select 'node_' || i as src, 'node_' || j as dst from range(40) a(i), range(40) b(j) where i < j")
def generator_graph(s, d):
    return triples.edges(generators.graph(s, nodes=40, density=1.0)).select("src", "dst")


@query("generator_contextual", "select 'fact_' || i as fact_id, 'high_arity_' || [3, 5, 8, 12][i % 4 + 1] as relation, [3, 5, 8, 12][i % 4 + 1] as arity, case when i > 0 then 'fact_' || (i // 2) || ',fact_' || (i // 3) end as parents from range(200) r(i)")
def generator_contextual(s, d):
    f = generators.contextual(s, 200)
    return f.select("fact_id", "relation", F.size("objects").alias("arity"), F.array_join(F.from_json("metadata", "parents array<string>")["parents"], ",").alias("parents"))


@query("parquet_round_trip", f"with {LINES} select fact_id, subject, context, num2, num3, obj4, vs, ve from lines_f")
def parquet_round_trip(s, d):
    path = scratch(s, "facts") + "/lines"
    T.lineitem_facts(s, d).write.parquet(path)
    slot = lambda k: F.get("objects", F.lit(k))
    return files.load(s, "parquet", path).select("fact_id", "subject", "context", slot(2)["dbl"].alias("num2"), slot(3)["dbl"].alias("num3"), slot(4)["str"].alias("obj4"), F.col("valid_start").alias("vs"), F.col("valid_end").alias("ve"))


@query("round_trip_assertion", f"with {PLACES}, {ORDERS} select 'places' as facts, count(*) as n, true as unchanged from places_f union all select 'orders', count(*), true from orders_f")
def round_trip_assertion(s, d):
    rows = [(name, f.count(), files.round_trips(f, scratch(s, "round"))) for name, f in (("places", T.place_facts(s, d)), ("orders", T.order_facts(s, d)))]
    return s.createDataFrame(rows, "facts string, n long, unchanged boolean")


@query("serialized_triples", f"with {PLACES} select fact_id as event_id, 'object_' as predicate, obj0 as value from places_f union all select fact_id, 'rdf:subject', subject from places_f")
def serialized_triples(s, d):
    t = triples.reify(T.place_facts(s, d)).where("predicate in ('object_', 'rdf:subject')")
    return files.rows_from_json(files.rows_to_json(t), t).select("event_id", "predicate", F.col("value.ref").alias("value"))


@query("store_exchange", f"with {ORDERS} select form, fact_id, context, confidence from orders_f, (values ('json'), ('msgpack'), ('parquet')) v(form)")
def store_exchange(s, d):
    """Exported in each format and imported into a store of its own."""
    base, out = scratch(s, "exchange"), None
    store = FactStore.create(s, f"{base}/from", T.order_facts(s, d))
    for form in ("json", "msgpack", "parquet"):
        store.export(f"{base}/{form}", form)
        into = FactStore.create(s, f"{base}/to-{form}")
        into.import_(f"{base}/{form}", form)
        one = into.facts().select(F.lit(form).alias("form"), "fact_id", "context", "confidence")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "store_changes",
    "select 'place/customer/' || c_custkey as fact_id, case when c_custkey % 10 = 0 then 'moved_to' else 'located_in' end as relation from customer where c_custkey % 7 <> 0"
    " union all select 'place/supplier/' || s_suppkey, 'located_in' from supplier union all select 'place/customer/7', 'back_in' from customer where c_custkey = 7",
)
def store_changes(s, d):
    """Created with customers; suppliers inserted, some customers updated, others deleted and one inserted again; then compacted."""
    places = T.place_facts(s, d)
    key = F.substring_index("fact_id", "/", -1).cast("long")
    customers = places.where(F.col("fact_id").startswith("place/customer/"))
    store = FactStore.create(s, scratch(s, "store") + "/changes", customers)
    store.insert(places.where(F.col("fact_id").startswith("place/supplier/")))
    store.update(customers.where(key % 10 == 0).withColumn("relation", F.lit("moved_to")).unionByName(places.where(F.col("fact_id").startswith("place/nation/"))))
    store.delete(customers.where(key % 7 == 0).select("fact_id"))
    store.insert(customers.where(key == 7).withColumn("relation", F.lit("back_in")))
    store.compact()
    return store.query(Query(Kind.GLOBAL)).select("fact_id", "relation")


@query("store_statistics", f"with {PLACES} select count(*) as facts, count(distinct subject) as subjects, 1::bigint as relations, count(*) * 10 as triples, 1.0::double as mean_arity from places_f")
def store_statistics(s, d):
    found = FactStore.create(s, scratch(s, "store") + "/statistics", T.place_facts(s, d)).statistics()
    return s.createDataFrame([tuple(found[k] for k in ("facts", "subjects", "relations", "triples", "mean_arity"))], "facts long, subjects long, relations long, triples long, mean_arity double")


@query(
    "store_estimates",
    f"""with {ORDERS}, f as (select unnest([{{'figure': 'facts', 'exact': count(distinct fact_id)::double}}, {{'figure': 'subjects', 'exact': count(distinct subject)::double}}, {{'figure': 'relations', 'exact': 1.0}},
        {{'figure': 'contexts', 'exact': count(distinct context)::double}}, {{'figure': 'mean_arity', 'exact': 3.0}}, {{'figure': 'relation_selectivity', 'exact': 1.0}}, {{'figure': 'median_confidence', 'exact': quantile_disc(confidence, 0.5)}}]) as x from orders_f)
    select x.figure as figure, x.exact as exact, true as near from f""",
)
def store_estimates(s, d):
    """What the sketches of three commits say together, beside exact counts of the facts: within five in a hundred."""
    f = T.order_facts(s, d)
    store = FactStore.create(s, scratch(s, "store") + "/estimates", f.where("seq % 3 = 0"))
    for k in (1, 2):
        store.insert(f.where(f"seq % 3 = {k}"))
    exact = store.facts().agg(
        F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects"), F.count_distinct("relation").alias("relations"), F.count_distinct("context").alias("contexts"), F.avg(F.size("objects")).alias("mean_arity"),
        (1 / F.count_distinct("relation")).alias("relation_selectivity"), F.expr("percentile_disc(0.5) within group (order by confidence)").alias("median_confidence"),
    )
    tall = lambda df, name: df.unpivot([], [F.col(c).cast("double").alias(c) for c in exact.columns], "figure", name)
    both = tall(exact, "exact").join(tall(store.estimates().select(*exact.columns), "estimate"), "figure")
    return both.select("figure", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("store_verified", f"with {PLACES} select 'reference to nothing known: ' || obj0 as \"check\", count(*) as violations from places_f where starts_with(obj0, 'region/') group by 1 union all select 'versions disagree', 0")
def store_verified(s, d):
    known = T.read(s, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("entity"))
    return FactStore.create(s, scratch(s, "store") + "/verified", T.place_facts(s, d)).verify(known)


@query("store_explained", "select true as facts, true as local, true as filtered, true as scanned")
def store_explained(s, d):
    text = FactStore.create(s, scratch(s, "store") + "/explained", T.place_facts(s, d)).explain(Query(Kind.LOOKUP, subject="nation/3"))
    return s.createDataFrame([("path='facts'" in text, "scope='local'" in text, "filter subject" in text, "Scan parquet" in text)], "facts boolean, local boolean, filtered boolean, scanned boolean")


@query("written_results", "select 'csv' as form, 'r_regionkey,r_name' as line union all select 'csv', r_regionkey || ',' || r_name from region union all select 'markdown', '| r_regionkey | r_name |' union all select 'markdown', '| --- | --- |' union all select 'markdown', '| ' || r_regionkey || ' | ' || r_name || ' |' from region")
def written_results(s, d):
    base, rows = scratch(s, "results"), T.read(s, d, "region").select("r_regionkey", "r_name").coalesce(1)
    out = None
    for form in ("csv", "markdown"):
        files.write_result(rows, f"{base}/{form}", form)
        one = s.read.text(f"{base}/{form}").select(F.lit(form).alias("form"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


@query("streamed_facts", f"with {ORDERS} select fact_id, context from orders_f where confidence <= 0.9")
def streamed_facts(s, d):
    """Order facts as a stream of files: those with a broken confidence fall out, each id comes once."""
    base, f = scratch(s, "stream"), T.order_facts(s, d)
    f = f.withColumn("confidence", F.when(F.col("confidence") > 0.9, F.lit(7.0)).otherwise(F.col("confidence")))
    f.withColumn("provenance", F.col("provenance").withField("recorded_at", F.expr("timestamp_ntz'2024-01-01'"))).write.json(f"{base}/in")
    ingest.append(ingest.once(ingest.valid(ingest.read(s, f"{base}/in"))), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return s.read.schema(V.FACT).parquet(f"{base}/out").select("fact_id", "context")
