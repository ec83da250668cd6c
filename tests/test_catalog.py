"""Every core query against the SQL that states its result, in DuckDB on the same files."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from factloom.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr)
    expected = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == expected


def test_neighborhood_is_not_capped(spark, tmp_path):
    for table, key, nation, n in (("customer", "c_custkey", "c_nationkey", 1200), ("supplier", "s_suppkey", "s_nationkey", 5), ("nation", "n_nationkey", "n_regionkey", 5)):
        spark.range(n).selectExpr(f"id as {key}", f"{'4' if n > 5 else 'id'} as {nation}").write.parquet(str(tmp_path / f"{table}.parquet"))
    assert QUERIES["lang_neighborhood"](spark, str(tmp_path)).count() == 1202


def test_intersection_closure_covers_the_whole_table(spark, sf_dir, duck):
    sets = {}
    for kind, key, above, k, up in (("customer", "c_custkey", "nation", 0, "c_nationkey"), ("supplier", "s_suppkey", "nation", 0, "s_nationkey"), ("nation", "n_nationkey", "region", 0, "n_regionkey")):
        for i, j in duck.sql(f"select {key}, {up} from {kind}").fetchall():
            for name in (f"{kind}/{i}", f"{above}/{j}", "world"):
                sets.setdefault(name, set()).add(f"{kind}/{i}")
    closed = {frozenset(x) for x in sets.values()}
    while more := {a & b for a in closed if len(a) > 1 for b in closed if len(b) > 1} - closed - {frozenset()}:
        closed |= more
    got = QUERIES["intersection_closure"](spark, sf_dir).collect()
    assert sorted(r.n for r in got) == sorted(map(len, closed))
    assert len({r.open_set for r in got}) == len(got)


def test_interval_sums_beyond_a_bigint_are_whole(spark, tmp_path):
    n = 3_600_000  # of 30 days each: more microseconds than a bigint holds
    at = "timestamp_ntz'1999-05-05'"
    spark.range(n).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice", f"{at} as o_orderdate", "'LOW' as o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r.w: (r.n, int(r.overlap_us), r.first_fact) for r in QUERIES["interval_join"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(("all", "open"), (n, n * 30 * 86_400_000_000, "order/0"))


def test_nothing_is_registered_without_reason():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)
