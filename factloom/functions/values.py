"""Slots of a fact: a tagged union in one struct, so that any two slots compare with ``=``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("str", T.StringType()),
        T.StructField("lng", T.LongType()),
        T.StructField("dbl", T.DoubleType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("type_hint", T.StringType()),
    ]
)
ATTRIBUTE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", VALUE)])
PROVENANCE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("recorded_at", T.TimestampNTZType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("method", T.StringType()),
    ]
)
FACT = T.StructType(
    [
        T.StructField("fact_id", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("relation", T.StringType()),
        T.StructField("objects", T.ArrayType(VALUE)),
        T.StructField("attributes", T.ArrayType(ATTRIBUTE)),
        T.StructField("context", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("provenance", PROVENANCE),
        T.StructField("valid_start", T.TimestampNTZType()),
        T.StructField("valid_end", T.TimestampNTZType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)
# The semantic types a slot may be hinted with.
SEMANTIC_TYPES = ("ENTITY", "RELATION", "ATTRIBUTE", "EVENT", "STATE", "PROVENANCE", "TEMPORAL", "SPATIAL", "QUANTITY", "ABSTRACTION", "UNKNOWN")


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _slot(kind: str, field: str, value, hint: str) -> Column:
    parts = []
    for f in VALUE.fields:
        if f.name == "kind":
            parts.append(F.lit(kind).alias("kind"))
        elif f.name == "type_hint":
            parts.append(F.lit(hint).alias("type_hint"))
        elif f.name == field:
            parts.append(_column(value).cast(f.dataType).alias(f.name))
        else:
            parts.append(F.lit(None).cast(f.dataType).alias(f.name))
    return F.struct(*parts).cast(VALUE)


def ref(x, hint: str = "ENTITY") -> Column:
    return _slot("ref", "ref", x, hint)


def text(x, hint: str = "ATTRIBUTE") -> Column:
    return _slot("str", "str", x, hint)


def integer(x, hint: str = "QUANTITY") -> Column:
    return _slot("int", "lng", x, hint)


def number(x, hint: str = "QUANTITY") -> Column:
    return _slot("float", "dbl", x, hint)


def boolean(x, hint: str = "ATTRIBUTE") -> Column:
    return _slot("bool", "bool", x, hint)


def as_number(v: Column) -> Column:
    """The numeric reading of a slot, null where it has none."""
    return F.coalesce(v["lng"].cast("double"), v["dbl"])


def as_text(v: Column) -> Column:
    """A readable form of any slot; numbers print as Spark prints them."""
    return F.coalesce(v["ref"], v["str"], v["lng"].cast("string"), v["dbl"].cast("string"), v["bool"].cast("string"))


def canonical(v: Column) -> Column:
    """The slot with integers and floats in one form, for comparisons across representations."""
    num = as_number(v)
    return F.struct(
        F.when(num.isNotNull(), F.lit("num")).otherwise(v["kind"]).alias("kind"),
        v["ref"].alias("ref"),
        v["str"].alias("str"),
        num.alias("num"),
        v["bool"].alias("bool"),
        v["type_hint"].alias("type_hint"),
    )


def attribute(attributes: Column, key: str) -> Column:
    """The value of ``key``, null if there is none."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(1))["value"]


def attributes_of(**values: Column) -> Column:
    """Attribute array, sorted by key."""
    return F.array(*(F.struct(F.lit(k).alias("key"), values[k].alias("value")) for k in sorted(values))).cast(T.ArrayType(ATTRIBUTE))


NO_ATTRIBUTES = "cast(array() as array<struct<key:string,value:" + VALUE.simpleString() + ">>)"


def mentions(objects: Column, entity) -> Column:
    """Whether a reference slot names ``entity``."""
    return F.exists(objects, lambda v: (v["kind"] == "ref") & (v["ref"] == entity))


def content_id(*columns: str) -> Column:
    """SHA-256 over the JSON form of the columns: equal content, equal id."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def prefixed(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + "/"), c.cast("string"))
