"""Facts out of relational tables: one declarative projection each, so filters reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + "/"), F.col(column).cast("string"))


def _fact(df: DataFrame, **parts) -> DataFrame:
    empty = {
        "attributes": F.expr(V.NO_ATTRIBUTES),
        "confidence": F.lit(1.0),
        "valid_start": F.lit(None),
        "valid_end": F.lit(None),
        "metadata": F.lit(None),
        "seq": F.lit(0),
    }
    source, method = parts.pop("source", F.lit("unknown")), parts.pop("method", F.lit("unknown"))
    recorded = parts.pop("recorded_at", F.lit(None).cast("timestamp_ntz"))
    parts = empty | parts
    parts["provenance"] = F.struct(source.alias("source"), recorded.alias("recorded_at"), parts["confidence"].cast("double").alias("confidence"), method.alias("method"))
    return df.select(*(parts[f.name].cast(f.dataType).alias(f.name) for f in V.FACT.fields))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer placed_order [order, price, priority] at world.<year>.<status>, valid for 30 days."""
    o = read(spark, sf_dir, "orders")
    return _fact(
        o,
        fact_id=_key("order", "o_orderkey"),
        subject=_key("customer", "o_custkey"),
        relation=F.lit("placed_order"),
        objects=F.array(V.ref(_key("order", "o_orderkey")), V.number(F.col("o_totalprice")), V.text(F.col("o_orderpriority"))),
        attributes=V.attributes_of(status=V.text(F.col("o_orderstatus"))),
        context=F.concat(F.lit("world."), F.year("o_orderdate").cast("string"), F.lit("."), F.col("o_orderstatus")),
        confidence=(F.col("o_orderkey") % 100) / F.lit(100.0),
        source=F.col("o_orderpriority"),
        method=F.when(F.col("o_orderkey") % 2 == 0, "import").otherwise("manual"),
        valid_start=F.col("o_orderdate"),
        valid_end=F.col("o_orderdate") + F.expr("interval 30 days"),
        seq=F.col("o_orderkey"),
    )


def lineitem_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order shipped [part, supplier, quantity, price, flag], valid for the day."""
    li = read(spark, sf_dir, "lineitem")
    return _fact(
        li,
        fact_id=F.concat(F.lit("line/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")),
        subject=_key("order", "l_orderkey"),
        relation=F.lit("shipped"),
        objects=F.array(V.ref(_key("part", "l_partkey")), V.ref(_key("supplier", "l_suppkey")), V.number(F.col("l_quantity")), V.number(F.col("l_extendedprice")), V.text(F.col("l_returnflag"))),
        context=F.concat(F.lit("world."), F.year("l_shipdate").cast("string")),
        source=F.lit("lineitem"),
        method=F.lit("import"),
        valid_start=F.col("l_shipdate"),
        valid_end=F.col("l_shipdate") + F.expr("interval 1 day"),
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user <event type> [value] at world.events.<type>, valid for the hour, with its properties as metadata."""
    e = read(spark, sf_dir, "events")
    return _fact(
        e,
        fact_id=_key("event", "event_id"),
        subject=_key("user", "user_id"),
        relation=F.col("event_type"),
        objects=F.array(V.number(F.col("value"))),
        context=F.concat(F.lit("world.events."), F.col("event_type")),
        source=F.lit("stream"),
        method=F.lit("sensor"),
        valid_start=F.col("ts"),
        valid_end=F.col("ts") + F.expr("interval 1 hour"),
        metadata=F.col("props"),
        seq=F.col("event_id"),
    )


def place_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """located_in: customers and suppliers in nations, nations in regions."""

    def one(table: str, kind: str, key: str, above: str, above_key: str) -> DataFrame:
        return _fact(
            read(spark, sf_dir, table),
            fact_id=F.concat(F.lit(f"place/{kind}/"), F.col(key).cast("string")),
            subject=_key(kind, key),
            relation=F.lit("located_in"),
            objects=F.array(V.ref(_key(above, above_key))),
            context=F.lit("world.geo"),
            source=F.lit(table),
            method=F.lit("import"),
        )

    return one("customer", "customer", "c_custkey", "nation", "c_nationkey").unionByName(one("supplier", "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(one("nation", "nation", "n_nationkey", "region", "n_regionkey"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as partial facts of one id: what its text says, and what its label says.

    Documents whose id is divisible by 7 get a label that names another source, so that gluing has conflicts.
    """
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    seen = _fact(
        d,
        fact_id=_key("doc", "doc_id"),
        subject=_key("doc", "doc_id"),
        relation=F.lit("written_in"),
        objects=F.array(V.text(F.col("lang"))),
        attributes=V.attributes_of(source=V.text(F.col("source"))),
        context=F.lit("world.corpus"),
        confidence=F.lit(0.5),
        source=F.col("source"),
        method=F.lit("crawl"),
        seq=F.col("doc_id") * 2,
    )
    both = l.join(d.select("doc_id", "lang", "source"), "doc_id")
    named = F.when(F.col("doc_id") % 7 == 0, F.lit("elsewhere")).otherwise(F.col("source"))
    labelled = _fact(
        both,
        fact_id=_key("doc", "doc_id"),
        subject=_key("doc", "doc_id"),
        relation=F.lit("written_in"),
        objects=F.array(V.text(F.col("lang"))),
        attributes=V.attributes_of(quality=V.integer(F.col("quality")), source=V.text(named)),
        context=F.lit("world.labels"),
        confidence=F.lit(0.9),
        source=F.lit("unknown"),
        method=F.lit("annotate"),
        seq=F.col("doc_id") * 2 + 1,
    )
    return seen.unionByName(labelled)


def derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance DAG over orders: order k derives from k div 2 first, then from k div 3; 0 is the root."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    halves = o.where("k > 0").select(_key("order", "k").alias("child"), F.concat(F.lit("order/"), F.floor(F.col("k") / 2).cast("string")).alias("parent"), F.lit(0).alias("pos"))
    thirds = o.where("k > 0").select(_key("order", "k").alias("child"), F.concat(F.lit("order/"), F.floor(F.col("k") / 3).cast("string")).alias("parent"), F.lit(1).alias("pos"))
    return halves.unionByName(thirds)
