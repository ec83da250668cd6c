"""The pipeline's stages against brute force over the small tables, and the registered queries' columns."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from factloom.llm import catalog
from tests.llm.test_operators import components, lower


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[: len(names)] == names
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    language, exact, near, clean, mixed = left
    assert language == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    last = {}
    for i in sorted(language):
        last[lower(rows[i].text)] = i
    assert exact == set(last.values())
    assert near == {i for i, x in components([(i, rows[i].text) for i in sorted(exact)], 5).items() if x[2]}
    cut = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) + " "
    items = [cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaks = {i for i in near if any(x in cut(rows[i].text) for x in items)}
    assert leaks and clean <= near - leaks and len(near - leaks - clean) <= 1
    assert mixed < clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()} == mixed


COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2": {"doc_id": "bigint", "item_id": "bigint"},
    "op3": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op8": {"doc_id": "bigint", "p": "double", "kept": "boolean"},
    "op9": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op11": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op12": {"part": "string", "filter_order": "string", "step": "int", "shapley": "bigint"} | {c: "bigint" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")},
    "op13": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_registered_query(name, spark, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    have = dict(df.dtypes)
    for column, kind in COLUMNS[name.split("_")[0]].items():
        assert have[column] == kind
    rows = df.collect()
    if name.startswith(("op2_", "op5_", "op11_", "op12_", "op13_")):
        assert rows
    else:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name in catalog.ORACLES:
        import duckdb

        c = duckdb.connect()
        for t in ("documents", "conversations", "benchmark", "labels"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = c.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        at = [want.columns.index(x) for x in df.columns]
        round_ = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(map(repr, map(round_, rows))) == sorted(repr(round_(tuple(r[k] for k in at))) for r in want.fetchall())
