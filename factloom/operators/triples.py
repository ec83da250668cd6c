"""Reification to triples and back, pattern scans, and the edge and statement views."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from factloom.functions import values as V
from factloom.functions.staging import cut

OBJECT = "object_"
ATTR = "attr:"
META = "meta:"
# What stands once in a fact: its predicate and the field of the slot.
SINGLE = {
    "subject": ("rdf:subject", "ref"),
    "relation": ("rdf:predicate", "str"),
    "context": ("context", "str"),
    "confidence": ("confidence", "dbl"),
    "source": ("prov:source", "str"),
    "recorded_at": ("prov:recorded_at", "str"),
    "sure": ("prov:confidence", "dbl"),
    "method": ("prov:method", "str"),
    "valid_start": ("valid_start", "str"),
    "valid_end": ("valid_end", "str"),
}


def reify(facts: DataFrame) -> DataFrame:
    """(event_id, predicate, pos, value, context): one row per part of a fact, by a single explode.

    Nine rows stand for type, subject, predicate, context, confidence and the
    four parts of provenance; one for each object and attribute, up to two for
    the interval and one for each key of the metadata.
    """

    def row(predicate: Column | str, value: Column, pos: Column | None = None) -> Column:
        return F.struct((F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"), (F.lit(0) if pos is None else pos).cast("int").alias("pos"), value.alias("value"))

    p = F.col("provenance")
    fixed = F.array(
        row("rdf:type", V.text(F.lit("rdf:Statement"), "RELATION")),
        row("rdf:subject", V.ref(F.col("subject"))),
        row("rdf:predicate", V.text(F.col("relation"), "RELATION")),
        row("context", V.text(F.col("context"))),
        row("confidence", V.number(F.col("confidence"))),
        row("prov:source", V.text(p["source"], "PROVENANCE")),
        row("prov:recorded_at", V.text(p["recorded_at"].cast("string"), "PROVENANCE")),
        row("prov:confidence", V.number(p["confidence"], "PROVENANCE")),
        row("prov:method", V.text(p["method"], "PROVENANCE")),
    )
    times = F.array(
        F.when(F.col("valid_start").isNotNull(), row("valid_start", V.text(F.col("valid_start").cast("string"), "TEMPORAL"))),
        F.when(F.col("valid_end").isNotNull(), row("valid_end", V.text(F.col("valid_end").cast("string"), "TEMPORAL"))),
    )
    meta = F.coalesce(F.map_entries(F.from_json("metadata", T.MapType(T.StringType(), T.StringType()))), F.array().cast("array<struct<key:string,value:string>>"))
    parts = F.concat(
        fixed,
        F.array_compact(times),
        F.transform("objects", lambda v, i: row(F.lit(OBJECT), v, i)),
        F.transform("attributes", lambda a: row(F.concat(F.lit(ATTR), a["key"]), a["value"])),
        F.transform(meta, lambda m: row(F.concat(F.lit(META), m["key"]), V.text(m["value"]))),
    )
    return facts.select("fact_id", "context", F.explode(parts).alias("t")).select(F.col("fact_id").alias("event_id"), "t.predicate", "t.pos", "t.value", "context")


def _folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triples of one event that follow each other as one row of its parts; they may lie in several batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = _changes(b.column(0))
        if held and not len(new) and held[0].column(0)[0] == b.column(0)[0]:
            held.append(b)
            continue
        last = int(new[-1]) if len(new) else 0
        if held or last:
            yield _parts([*held, b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield _parts(held)


def _changes(key: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls always do."""
    return np.flatnonzero(pc.fill_null(pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)), True).to_numpy(zero_copy_only=False)) + 1


def _parts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    key, part, pos, name, void, *slot = (c.chunk(0) for c in pa.Table.from_batches(batches).combine_chunks().columns)
    field = dict(zip(V.VALUE.fieldNames(), slot, strict=True))
    kinds, starts = part.to_numpy(), np.append(0, _changes(key))
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    at = [np.flatnonzero(kinds == k) for k in range(len(SINGLE) + 3)]
    if any((np.diff(row[at[k]]) == 0).any() for k in range(len(SINGLE))):
        starts = row = np.arange(len(key))  # a part stands twice: each triple by itself, the grouping takes the largest
    out = {"event_id": key.take(pa.array(starts))}
    for k, (column, (_, of)) in enumerate(SINGLE.items()):
        found = np.full(len(starts), -1)
        found[row[at[k]]] = at[k]
        out[column] = field[of].take(pa.array(found, mask=found < 0))
    for k, (column, label) in enumerate((("objects", "pos"), ("attributes", "key"), ("meta", "key")), len(SINGLE)):
        rows = pa.array(at[k])
        value = field["str"].take(rows) if column == "meta" else pa.StructArray.from_arrays([a.take(rows) for a in slot], names=list(field), mask=void.take(rows))
        items = pa.StructArray.from_arrays([(pos if label == "pos" else name).take(rows), value], names=[label, "value"])
        out[column] = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[k], np.append(starts, len(key))), pa.int32()), items)
    return pa.RecordBatch.from_pydict(out)


def reconstruct(triples: DataFrame) -> DataFrame:
    """Facts out of their triples, in any order, by one exchange; seq is not part of a triple and comes back 0.

    Triples of an event that follow each other become one row where they are
    read, so that neither the exchange nor a sort holds a row for each triple.
    """
    p, v = F.col("predicate"), F.col("value")
    attribute, meta = p.startswith(ATTR), p.startswith(META)
    part = F.lit(-1)
    for k, test in reversed(list(enumerate([*(p == name for name, _ in SINGLE.values()), p == OBJECT, attribute, meta]))):
        part = F.when(test, k).otherwise(part)
    # a slot goes to Arrow by its fields: a struct there is measured anew for each row of a batch
    cols = triples.select(
        "event_id",
        part.cast("int").alias("part"),
        "pos",
        F.when(attribute, F.substring(p, len(ATTR) + 1, 1 << 20)).when(meta, F.substring(p, len(META) + 1, 1 << 20)).alias("name"),
        v.isNull().alias("void"),
        *(F.when((p == OBJECT) | attribute, v[f]).alias(f) if f in ("kind", "type_hint") else v[f].alias(f) for f in V.VALUE.fieldNames()),
    )
    slot, key = V.VALUE.simpleString(), cols.schema["event_id"].dataType.simpleString()
    single = ", ".join(f"{column} {'double' if field == 'dbl' else 'string'}" for column, (_, field) in SINGLE.items())
    parts = cols.mapInArrow(_folded, f"event_id {key}, {single}, objects array<struct<pos:int,value:{slot}>>, attributes array<struct<key:string,value:{slot}>>, meta array<struct<key:string,value:string>>")
    # dealt before the grouping: grouping where triples are read would sort there and find next to nothing to merge
    g = parts.repartition("event_id").groupBy("event_id").agg(*(F.max(n).alias(n) for n in SINGLE), *(F.flatten(F.collect_list(n)).alias(n) for n in ("objects", "attributes", "meta")))
    whole = g.select(
        F.col("event_id").alias("fact_id"),
        "subject",
        "relation",
        F.transform(F.array_sort("objects"), lambda x: x["value"]).alias("objects"),
        F.array_sort("attributes").alias("attributes"),
        "context",
        "confidence",
        F.struct("source", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), F.col("sure").alias("confidence"), "method").alias("provenance"),
        F.col("valid_start").cast("timestamp_ntz").alias("valid_start"),
        F.col("valid_end").cast("timestamp_ntz").alias("valid_end"),
        F.when(F.size("meta") > 0, F.to_json(F.map_from_entries("meta"))).alias("metadata"),
        F.lit(0).cast("long").alias("seq"),
    )
    return whole.select(*(F.col(f.name).cast(f.dataType) for f in V.FACT.fields))


def scan_event(triples: DataFrame, event_id: str) -> DataFrame:
    return triples.where(F.col("event_id") == event_id)


def statements(facts: DataFrame) -> DataFrame:
    """(s, p, o, num, fact_id): subject-relation-object and subject-attribute-value, as pattern queries see facts.

    Objects and attributes are exploded apart, so that a bound predicate is a
    filter on the relation below the explode and reaches the scan.
    """
    whole = facts.select("fact_id", F.col("subject").alias("s"), F.col("relation").alias("p"), F.explode("objects").alias("v"))
    extra = facts.where(F.size("attributes") > 0).select("fact_id", F.col("subject").alias("s"), F.explode("attributes").alias("a")).select("fact_id", "s", F.col("a.key").alias("p"), F.col("a.value").alias("v"))
    v = F.col("v")
    return whole.unionByName(extra).select("s", "p", V.as_text(v).alias("o"), V.as_number(v).alias("num"), "fact_id")


def grouped(facts: DataFrame) -> DataFrame:
    """(s, p, o, num, fact_id) of ``statements``, a row a fact: p, o and num are arrays of its statements' (``apart``)."""
    slots = F.concat(F.coalesce("objects", F.array()), F.coalesce("attributes.value", F.array()))
    relations = F.array_repeat("relation", F.coalesce(F.size("objects"), F.lit(0)))
    return facts.select(
        F.col("subject").alias("s"),
        F.concat(relations, F.coalesce("attributes.key", F.array())).alias("p"),
        F.transform(slots, V.as_text).alias("o"),
        F.transform(slots, V.as_number).alias("num"),
        "fact_id",
    )


def apart(groups: DataFrame) -> DataFrame:
    return groups.select("s", F.inline(F.arrays_zip("p", "o", "num")), "fact_id")


def described(facts: DataFrame) -> DataFrame:
    """(s, p, o, num, fact_id) about facts themselves: type, subject, each object and attribute, context, confidence,
    source, and the ends of the interval as days since 1970."""

    def row(p, o: Column | None = None, num: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if o is None else o
        return F.struct((F.lit(p) if isinstance(p, str) else p).alias("p"), text.alias("o"), (F.lit(None) if num is None else num).cast("double").alias("num"))

    day = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    slot = lambda v: (V.as_text(v), V.as_number(v))
    parts = F.concat(
        F.array(row("rdf:type", F.col("relation")), row("subject", F.col("subject")), row("context", F.col("context")), row("confidence", num=F.col("confidence")), row("source", F.col("provenance.source"))),
        F.transform("objects", lambda v, k: row(F.concat(F.lit("arg"), k.cast("string")), *slot(v))),
        F.transform("attributes", lambda a: row(F.concat(F.lit("attr:"), a["key"]), *slot(a["value"]))),
        F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), row(p, num=day(c))) for p, c in (("validStart", "valid_start"), ("validEnd", "valid_end"))))),
    )
    rows = facts.select("fact_id", F.explode(parts).alias("t"))
    return rows.select(F.col("fact_id").alias("s"), "t.p", "t.o", "t.num", "fact_id")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triple-pattern scan: bound positions are filters."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(column) == value)
    return triples


def edges(facts: DataFrame) -> DataFrame:
    """(src, relation, dst, fact_id, pos): one edge from the subject to each reference."""
    return facts.select("fact_id", F.col("subject").alias("src"), "relation", F.posexplode("objects").alias("pos", "v")).where("v.kind = 'ref'").select("src", "relation", F.col("v.ref").alias("dst"), "fact_id", "pos")


def dictionary(triples: DataFrame) -> DataFrame:
    """(term, id): dense numbers of all terms in their order.

    Terms are dealt by ranges and numbered within each; only the ranges' counts are summed in one place.
    """
    terms = triples.select(F.col("s").alias("term")).union(triples.select("p")).union(triples.select("o")).where("term is not null").distinct()
    dealt = cut(terms.repartitionByRange("term").withColumn("part", F.spark_partition_id()), "dictionary")
    counts = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = counts.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy("term")) - 1
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").select("term", (F.col("before") + F.col("own")).alias("id"))  # a row a range


def orphans(triples: DataFrame, terms: DataFrame) -> DataFrame:
    """Triples whose subject is no known term."""
    return triples.join(terms, triples["s"] == terms["term"], "left_anti")
