"""The store: partitions that queries skip, and writers beside each other."""

from __future__ import annotations

from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import access
from factloom.operators.access import Kind, Query
from factloom.plans import partitions, planner
from factloom.plans.store import FactStore
from tests.test_operators import fact, ids, table  # noqa: F401
from tests.test_plans import facts  # noqa: F401


def many(spark, n):
    """Facts of ids 0..n-1 with all sorts of contexts and intervals."""
    k = F.col("id")
    start = F.when(k % 7 == 0, F.lit(None)).otherwise(F.expr("timestamp_ntz'1990-01-01' + make_interval(0, 0, 0, cast(id * 97 % 6000 as int))"))
    days = F.element_at(F.array(*map(F.lit, (0, 1, 30, 400, 2000, 9000, -800))), (k % 7 + 1).cast("int"))
    end = F.when(k % 5 == 0, F.lit(None)).otherwise(start + F.make_dt_interval(days))
    context = F.element_at(F.array(*map(F.lit, ("world", "world.a", "world.a.b", "world.ab", "a", "world.c.d.e", "c", None))), (k % 8 + 1).cast("int"))
    parts = {"fact_id": k.cast("string"), "subject": F.concat(F.lit("s"), k % 20), "relation": F.lit("r"), "objects": F.expr(f"cast(array() as array<{V.VALUE.simpleString()}>)"), "attributes": F.expr(V.NO_ATTRIBUTES), "context": context, "confidence": F.lit(1.0), "valid_start": start, "valid_end": end, "seq": F.lit(0)}
    none = F.lit(None)
    return spark.range(n).select(*(parts.get(f.name, none).cast(f.dataType).alias(f.name) for f in V.FACT.fields))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    f = many(spark, 700)
    store = FactStore.create(spark, str(tmp_path_factory.mktemp("p") / "s"), f.where("fact_id % 2 = 0"))
    store.insert(f.where("fact_id % 2 = 1"))
    return store, f.cache()


def test_partitions_never_lose_a_row(stored):
    store, f = stored
    times = [None, "1990", "1993-06-15", "1994-01-01", "1996", "2020"]
    for context, start, end in product(["world", "world.a", "a", "world.c.d", "nowhere"], times, times):
        if start and end and start >= end:
            continue
        q = Query(Kind.TEMPORAL if start or end else Kind.CONTEXT, context=context, start=start, end=end)
        kept = partitions.with_columns(f).where(access.predicate(q))
        assert kept.where(~F.coalesce(partitions.pruning(q), F.lit(False))).isEmpty(), q
    for q in (Query(Kind.TEMPORAL, start="1993"), Query(Kind.TEMPORAL, context="world.a", end="1992-05-05"), Query(Kind.CONTEXT, context="a"), Query(Kind.TEMPORAL)):
        assert ids(store.query(q)) == ids(access.run(f, q)) != []


def test_plans_show_partition_filters(stored):
    store, _ = stored
    plan = planner.explain(store.query(Query(Kind.TEMPORAL, context="world.a", start="1995", end="1996")))
    line = next(x for x in plan.splitlines() if "PartitionFilters" in x)
    assert "root_part" in line and "start_year" in line and "span" in line
    files = lambda q: len(store.query(q).inputFiles())
    read = store._facts(store.state()).where(partitions.pruning(Query(Kind.TEMPORAL, context="world.c", start="1991", end="1992")))
    dirs = {r.f for r in read.select(F.regexp_extract(F.input_file_name(), "start_year=([^/]*)", 1).alias("f")).distinct().collect()}
    assert dirs and dirs <= {"1990", "1991", *(str(y) for y in range(1980, 1992))}
    assert files(Query(Kind.GLOBAL)) > 0


def test_a_fresh_snapshot_is_read_by_a_scan_alone(spark, tmp_path):
    store = FactStore.create(spark, str(tmp_path / "s"), many(spark, 50))
    assert "Exchange" not in planner.explain(store.query(Query(Kind.LOOKUP, subject="s1")))
    store.insert(many(spark, 10))
    assert "Join" in planner.explain(store.facts())
    store.compact()  # brings the insert's marks, for writers that began before it
    store.compact()
    assert "Exchange" not in planner.explain(store.facts())


def test_create_does_not_empty_a_store(spark, facts, tmp_path):  # noqa: F811
    FactStore.create(spark, str(tmp_path / "s"), facts)
    with pytest.raises(ValueError):
        FactStore.create(spark, str(tmp_path / "s"))
    assert ids(FactStore(spark, str(tmp_path / "s")).facts()) == ["1", "2", "3", "4"]
    with pytest.raises(ValueError):
        FactStore(spark, str(tmp_path / "none")).facts()


def interrupted(monkeypatch, store, method, then):
    """Run ``then`` once, just before ``store`` takes a number in ``method``."""
    claim, ran = FactStore._claim, []

    def first(self, number, record):
        if self is store and not ran:
            ran.append(1)
            then()
        return claim(self, number, record)

    monkeypatch.setattr(FactStore, "_claim", first)
    method()
    monkeypatch.setattr(FactStore, "_claim", claim)
    assert ran


def test_an_insert_beside_compact_is_not_lost(spark, facts, table, tmp_path, monkeypatch):  # noqa: F811
    a, b = FactStore.create(spark, str(tmp_path / "s"), facts), FactStore(spark, str(tmp_path / "s"))
    interrupted(monkeypatch, b, lambda: b.insert(table(fact("5", "dave"))), lambda: (a.compact(), a.clean()))
    assert ids(a.facts()) == ["1", "2", "3", "4", "5"]
    interrupted(monkeypatch, a, a.compact, lambda: b.insert(table(fact("6", "erin"), fact("1", "alice", "left"))))
    assert ids(a.facts()) == ["1", "2", "3", "4", "5", "6"]
    assert [r.relation for r in a.query(Query(Kind.LOOKUP, subject="alice")).collect()] == ["left"]
    a.compact()
    assert a.clean() > 0 and a.clean() == 0
    assert ids(a.facts()) == ["1", "2", "3", "4", "5", "6"] == ids(a.versions())


def test_an_older_version_committed_late_stays_older(spark, facts, table, tmp_path, monkeypatch):  # noqa: F811
    a, b = FactStore.create(spark, str(tmp_path / "s"), facts), FactStore(spark, str(tmp_path / "s"))
    interrupted(monkeypatch, a, lambda: a.insert(table(fact("1", "alice", "first"))), lambda: b.insert(table(fact("1", "alice", "second"))))
    relations = lambda: [r.relation for r in a.query(Query(Kind.LOOKUP, subject="alice")).collect()]
    assert relations() == ["second"]
    b.compact()
    assert relations() == ["second"]

    def beside():
        b.insert(table(fact("1", "alice", "third")))

    claim = FactStore._claim
    held = []

    def late(self, number, record):
        # The insert's number is taken after the snapshot has read its state, and before the snapshot's own.
        if self is b and "base" in record and not held:
            held.append(1)
            a.insert(table(fact("1", "alice", "fourth")))
        return claim(self, number, record)

    beside()
    monkeypatch.setattr(FactStore, "_claim", late)
    b.compact()
    monkeypatch.setattr(FactStore, "_claim", claim)
    assert held and relations() == ["fourth"]
    b.compact()
    assert relations() == ["fourth"] and ids(b.facts()) == ["1", "2", "3", "4"]


def test_two_snapshots_at_once(spark, facts, tmp_path, monkeypatch):  # noqa: F811
    a, b = FactStore.create(spark, str(tmp_path / "s"), facts), FactStore(spark, str(tmp_path / "s"))
    interrupted(monkeypatch, a, a.compact, b.compact)
    assert ids(a.facts()) == ["1", "2", "3", "4"] and a.clean() == 1
    interrupted(monkeypatch, b, lambda: b.delete(["1"]), a.compact)
    assert ids(a.facts()) == ["2", "3", "4"]


def test_created_versions(spark, table, tmp_path):  # noqa: F811
    rows = table(fact("1", "a", "old", seq=1), fact("1", "a", "new", seq=2), fact("1", "a", "new", seq=2), fact("2", "b", seq=9))
    store = FactStore.create(spark, str(tmp_path / "s"), rows)
    assert ids(store.facts()) == ["1", "2"] and ids(store.versions()) == ["1", "1", "2"]
    assert {r.relation for r in store.facts().where("fact_id = '1'").collect()} == {"new"}
    assert store.state().seq == 9


def test_times_at_the_edges():
    assert "start_year" in str(partitions.during(datetime(1, 1, 1), datetime(9999, 12, 31)))
    assert "start_year" in str(partitions.during(None, datetime.min))


def test_estimates_merge(spark, tmp_path):
    store = FactStore.create(spark, str(tmp_path / "s"))
    assert store.estimates().first().versions == 0 and store.estimates().first().median_confidence is None
    store.insert(many(spark, 900))
    store.insert(many(spark, 1000).where("fact_id >= 500").withColumn("confidence", F.lit(0.5)))
    r = store.estimates().first()
    assert r.versions == 1400 and abs(r.facts - 1000) < 60 and r.subjects == 20 and r.relations == 1 and r.contexts == 7
    assert (r.low_confidence, r.high_confidence) == (0.5, 1.0)
    assert "sketches" in planner.explain(store.estimates()) and "/facts/" not in planner.explain(store.estimates())
    store.compact()
    r = store.estimates().first()
    assert r.versions == 1000 and abs(r.facts - 1000) < 60
    assert store.clean() == 3


def test_a_write_shuffles_whole_facts_once(spark, tmp_path, monkeypatch):
    """Rows that repeat a version are made one, and where there are none nothing is laid twice."""
    f, laid = many(spark, 30), []
    lay = FactStore._lay
    monkeypatch.setattr(FactStore, "_lay", lambda self, rows, into: (laid.append(planner.explain(rows)), lay(self, rows, into))[1])
    store = FactStore.create(spark, str(tmp_path / "a"), f)
    assert len(laid) == 1 and "Exchange" not in laid[0] and "Aggregate" not in laid[0]
    again = f.where("fact_id < 5")
    other = again.withColumn("relation", F.lit("other"))
    twice = FactStore.create(spark, str(tmp_path / "b"), f.unionByName(again).unionByName(other).unionByName(again.withColumn("seq", F.lit(9).cast("long"))))
    assert len(laid) == 3
    assert ids(twice.facts()) == ids(f) and twice.facts().where("seq = 9").count() == 5 and twice.versions().count() == 35
    assert ids(store.facts()) == ids(f)


def test_exported_json_is_compressed(spark, tmp_path):
    store = FactStore.create(spark, str(tmp_path / "s"), many(spark, 30))
    store.export(str(tmp_path / "j"), "json")
    assert all(p.suffix == ".gz" for p in (tmp_path / "j").glob("part-*"))
    other = FactStore.create(spark, str(tmp_path / "o"))
    other.import_(str(tmp_path / "j"), "json")
    assert ids(other.facts()) == ids(store.facts())
