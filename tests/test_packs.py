"""Packed exchanges against Spark's own: the same rows in the same partitions, in order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import packs


def parts(df):
    out: dict = {}
    for r in df.withColumn("part", F.spark_partition_id()).collect():
        out.setdefault(r.part, []).append(tuple(r)[:-1])
    return out


@pytest.mark.parametrize("chunk", [1, 1 << 27])
def test_dealt(spark, monkeypatch, chunk):
    monkeypatch.setattr(packs, "CHUNK", chunk)
    rows = spark.range(0, 5000, 1, 3).selectExpr("if(id % 11 = 0, null, concat('é', id % 700)) as a", "id as b", "if(id % 3 = 0, null, id / 7) as c", "array(string(id), null) as d")
    got, want = parts(packs.dealt(rows, "a", 5, ("a", "b"))), parts(rows.repartition(5, "a"))
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    for v in got.values():
        keys = [(r[0] is None, r[0] or "", r[1]) for r in v]
        assert keys == sorted(keys)
    assert packs.dealt(rows.limit(0), "a", 5, ("a",)).isEmpty()


@pytest.mark.parametrize("chunk", [1, 1 << 27])
def test_lists_come_apart(spark, monkeypatch, chunk):
    monkeypatch.setattr(packs, "CHUNK", chunk)
    rows = spark.range(0, 900, 1, 3).selectExpr("id", "transform(sequence(1, int(id % 4)), x -> if(id % 4 = 0 or x = 3, null, concat('t', (id * x) % 50))) as o", "transform(sequence(1, int(id % 4)), x -> x / 2) as n")
    rows = rows.where("id % 4 > 0").union(spark.sql("select 0L, cast(array() as array<string>), cast(array() as array<double>)"))
    got = packs.dealt(rows, "o", 4, ("o", "id"), ("o", "n"), lambda x: x.isNotNull() & ~x.isin("t7"))
    want = rows.select("id", F.inline(F.arrays_zip("o", "n"))).where("o <> 't7'").repartition(4, "o")
    assert got.schema.simpleString() == "struct<id:bigint,o:string,n:double>"
    assert {k: sorted(v) for k, v in parts(got).items()} == {k: sorted(v) for k, v in parts(want).items()}
