"""Each stage of the pipeline on odd rows and on none."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import docs, lower, none, odd  # noqa: F401

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_no_rows(spark, sf_dir, none, name):  # noqa: F811
    out = STAGES[name](spark, none, sf_dir)
    assert out.columns[: len(none.columns)] == none.columns and out.isEmpty()


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "decontamination"])
def test_odd_rows(spark, sf_dir, odd, name):  # noqa: F811
    out = STAGES[name](spark, odd, sf_dir)
    assert out.columns == odd.columns
    was, now = (Counter((r.doc_id, r.text) for r in x.select("doc_id", "text").collect()) for x in (odd, out))
    assert not now - was
    if name == "exact_dedup":
        assert {lower(t) for _, t in now} == {lower(t) for _, t in was}
        assert len({lower(t) for _, t in now}) == sum(now.values())
    elif name == "near_dedup":
        def linked(a, b):
            a, b = (set(zip(*(lower(t).split()[k:] for k in range(5)))) or {tuple(lower(t).split())} - {()} for t in (a, b))
            return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)

        # Ids from 8 stand for one row each: none that stays is linked with another that stays, and none goes without a link.
        stay = [(i, t) for i, t in now if i is not None and i >= 8]
        assert not any(linked(t, u) for k, (_, t) in enumerate(stay) for _, u in stay[:k])
        kept = {i for i, _ in now}
        gone = [(i, t) for i, t in was if i is not None and i >= 8 and i not in kept]
        assert gone and all(any(linked(t, u) for j, u in was if j != i) for i, t in gone)
    else:
        assert now == was
