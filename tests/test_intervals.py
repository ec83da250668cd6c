"""The overlap join against all pairs: every cell, open ends, ties, and a window over everything."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from factloom.operators import intervals

BASE = datetime(2001, 2, 27)
SHAPE = "{0} string, s timestamp_ntz, e timestamp_ntz"


def drawn(rng, n, name):
    out = []
    for k in range(n):
        start = BASE + timedelta(hours=rng.randrange(0, 24 * 60))
        length = rng.choice([0, -5, 1, 7, 24, 24 * 9, 24 * 40, None])
        out.append((f"{name}{k}", None if k % 17 == 5 else start, None if length is None else start + timedelta(hours=length)))
    return out


def meets(a, b):
    far = datetime(9999, 1, 1)
    (_, s, e), (_, t, f) = a, b
    if s is None or t is None or (e or far) <= s or (f or far) <= t:
        return False
    return s < (f or far) and t < (e or far)


@pytest.mark.parametrize("width", [3_600_000_000, intervals.DAY, intervals.DAY * 50])
@pytest.mark.parametrize("most", [2, 10**6])
def test_all_pairs(spark, width, most):
    rng = random.Random(width + most)
    a, b = drawn(rng, 90, "a"), drawn(rng, 60, "b") + [("all", datetime(1990, 1, 1), datetime(2020, 1, 1)), ("open", datetime(1990, 1, 1), None), ("same", BASE, BASE + timedelta(hours=1)), ("same", BASE, BASE + timedelta(hours=1))]
    left, right = spark.createDataFrame(a, SHAPE.format("x")), spark.createDataFrame(b, SHAPE.format("y"))
    got = sorted(map(tuple, intervals.overlap_join(left, right, "x", "y", ("s", "e"), ("s", "e"), width, most).collect()))
    assert got == sorted((p[0], q[0]) for p in a for q in b if meets(p, q))


def test_empty(spark):
    none = spark.createDataFrame([], SHAPE.format("x"))
    some = spark.createDataFrame([("y", BASE, None)], SHAPE.format("y"))
    assert intervals.overlap_join(none, some, "x", "y", ("s", "e"), ("s", "e")).isEmpty()
    assert intervals.overlap_join(none, none.withColumnRenamed("x", "y"), "x", "y", ("s", "e"), ("s", "e")).isEmpty()
    assert intervals.overlap_join(some.withColumnRenamed("y", "x"), some, "x", "y", ("s", "e"), ("s", "e")).count() == 1


def test_totals_join_equal_intervals_once(spark, monkeypatch):
    """As from all pairs, with many rows of few intervals; what is joined are the intervals."""
    rng = random.Random(3)
    times = [(s, e) for _, s, e in drawn(rng, 25, "t")]
    a, b = ([(f"{name}{k}", *rng.choice(times)) for k in range(400)] for name in "ab")
    b += [("twice", BASE, None), ("twice", BASE, BASE + timedelta(hours=900))]
    made, real = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda *args: made.append(real(*args)) or made[-1])
    got = intervals.overlap_totals(spark.createDataFrame(a, SHAPE.format("x")), spark.createDataFrame(b, SHAPE.format("y")), "x", "y", ("s", "e"), ("s", "e"))
    want: dict = {}
    for p in a:
        for q in b:
            if meets(p, q):
                end = min((t for t in (p[2], q[2]) if t is not None), default=None)
                us = None if end is None else (end - max(p[1], q[1])) // timedelta(microseconds=1)
                n, all_us, first = want.get(q[0], (0, None, "z"))
                want[q[0]] = (n + 1, all_us if us is None else (all_us or 0) + us, min(first, p[0]))
    assert {r.y: (r.n, r.overlap_us, r.first) for r in got.collect()} == want
    assert made[0].count() <= 26 * 27
