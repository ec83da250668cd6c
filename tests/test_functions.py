from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import contexts as C
from factloom.functions import temporal as T
from factloom.functions import values as V
from factloom.functions.expressions import ExpressionError, compile_expression


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "a, b, path_meet, path_join, poset_meet, poset_join",
    [
        ("world.a.b", "world.a.c", "world.a", "world", "world.a", "world.a"),
        ("world.a", "world.a.c", "world.a", "world.a", "world.a.c", "world.a"),
        ("x.a", "y.a", "world", "world", "world", None),
        ("world", "world", "world", "world", "world", "world"),
    ],
)
def test_lattice(spark, a, b, path_meet, path_join, poset_meet, poset_join):
    x, y = F.lit(a), F.lit(b)
    assert value(spark, C.path_meet(x, y)) == path_meet
    assert value(spark, C.path_join(x, y)) == path_join
    assert value(spark, C.poset_meet(x, y)) == poset_meet
    assert value(spark, C.poset_join(x, y)) == poset_join


def test_prefixes_go_by_segment(spark):
    assert value(spark, C.under(F.lit("world.2024.a"), "world.2024"))
    assert not value(spark, C.under(F.lit("world.20245"), "world.2024"))
    assert value(spark, C.under(F.lit("ctx.0"), "world"))
    assert value(spark, C.ancestors(F.lit("a.b.c"))) == ["a", "a.b", "a.b.c"]
    assert value(spark, C.restrict(F.lit("world"), "world.2024")) == "world.2024"
    assert value(spark, C.restrict(F.lit("world.2024"), "world")) is None


def test_bounds():
    assert T.bounds("2024", None) == (datetime(2024, 1, 1), datetime(2025, 1, 1))
    assert T.bounds("2024", None, whole_year=False) == (datetime(2024, 1, 1), None)
    assert T.bounds(None, "2024-03-01T02:00:00+02:00") == (None, datetime(2024, 3, 1))


@pytest.mark.parametrize(
    "start, end, lo, hi, want",
    [
        ("2020-01-01", "2021-01-01", datetime(2021, 1, 1), None, False),
        ("2020-01-01", None, datetime(2030, 1, 1), None, True),
        (None, None, None, None, False),
        ("2020-01-01", "2022-01-01", None, datetime(2020, 1, 1), False),
        ("2020-01-01", "2022-01-01", datetime(2021, 1, 1), datetime(2021, 6, 1), True),
    ],
)
def test_overlap_is_half_open(spark, start, end, lo, hi, want):
    c = lambda t: F.lit(t).cast("timestamp_ntz")
    assert value(spark, T.overlaps(c(start), c(end), lo, hi)) is want


def test_starts_before_is_strict(spark):
    assert not value(spark, T.starts_before(F.lit("2020-01-01").cast("timestamp_ntz"), datetime(2020, 1, 1)))


@settings(max_examples=25, deadline=None)
@given(st.integers(-50, 50), st.integers(-9, 9).filter(bool))
def test_floor_division_follows_the_divisor(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a long, b long").select(compile_expression("a // b").alias("q"), compile_expression("a % b").alias("r")).first()
    assert (row.q, row.r) == (a // b, a % b)


def test_expressions(spark):
    df = spark.createDataFrame([(1, "x", None), (5, "y", 2.0)], "a int, s string, n double")
    ids = lambda t: [r.a for r in df.where(compile_expression(t)).collect()]
    assert ids("0 < a < 3") == [1]
    assert ids("s in ['y', 'z'] and not a == 1") == [5]
    assert ids("n is None") == [1]
    assert ids("a ** 2 - 1 >= 24") == [5]
    for bad in ("__import__('os')", "a.b()", "[x for x in a]", "a if a else 1", "a +"):
        with pytest.raises(ExpressionError):
            compile_expression(bad)
    with pytest.raises(ExpressionError):
        compile_expression("zz > 1", {"a": F.col("a")})


def test_slots(spark):
    assert value(spark, V.as_number(V.integer(3))) == 3.0
    assert value(spark, V.as_text(V.boolean(True))) == "true"
    assert value(spark, V.canonical(V.integer(1)) == V.canonical(V.number(1.0)))
    assert not value(spark, V.canonical(V.integer(1)) == V.canonical(V.text("1")))
    assert value(spark, V.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000")))


def test_overlaps_do_not_depend_on_the_sessions_zone(spark):
    c = lambda t: F.lit(t).cast("timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            # The night in which New York's clocks skip an hour.
            assert value(spark, T.overlap_seconds(c("2024-03-10 00:00:00"), c(None), c("2024-03-10 00:30:00.25"), c("2024-03-10 04:00:00"))) == 12599.75
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
