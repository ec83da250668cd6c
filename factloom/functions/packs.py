"""Rows dealt to partitions in packs: an exchange carries the columns of many rows, in a fraction of the rows' own size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that a task holds at a time; those of one partition among them are a pack.
CHUNK = 128 << 20


def _pack(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    pq.write_table(rows, out, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False)
    return out.getvalue().to_pybytes()


def _apart(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each place of the lists, which are as long in a row; those without a partition are left out."""
    of = pc.list_parent_indices(batch.column(0))
    flat = [c.flatten() if pa.types.is_list(c.type) else c.take(of) for c in batch.columns]
    rows = pa.RecordBatch.from_arrays(flat, names=batch.schema.names)
    return rows.filter(flat[0].is_valid())


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, of which the first column is their partition's number, in; (number, pack) out."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        to = rows.column(0).to_numpy()
        order = np.argsort(to, kind="stable")
        to, rows = to[order], rows.remove_column(0).take(pa.array(order))
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        for lo, hi in zip(starts, np.append(starts[1:], len(to)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + 1], pa.int32()), pa.array([_pack(rows.slice(lo, hi - lo))], pa.binary())], names=["to", "pack"])

    held, size = [], 0
    for b in batches:
        held.append(_apart(b) if pa.types.is_list(b.schema.types[0]) else b)
        size += held[-1].nbytes
        if size >= CHUNK:
            yield from packed(held)
            held, size = [], 0
    if size:
        yield from packed(held)


def dealt(rows: DataFrame, by: str, n: int, order: tuple[str, ...], lists: tuple[str, ...] = (), keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """``rows.repartition(n, by).sortWithinPartitions(*order)``, sent in packs; a task holds a partition.

    If ``by`` is one of ``lists``, which are as long in a row, a row comes for each place of them of which ``keep`` is true.
    """
    to = lambda c: F.pmod(F.hash(c), F.lit(n))
    number = F.transform(by, lambda x: F.when(keep(x), to(x))) if lists else to(by)
    schema = T.StructType([T.StructField(f.name, f.dataType.elementType if f.name in lists else f.dataType) for f in rows.schema])

    def sorted_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [pq.read_table(pa.BufferReader(p.as_buffer()), use_threads=False) for b in batches for p in b.column(0)]
        if packs:
            whole = pa.concat_tables(packs)
            packs.clear()
            yield from whole.sort_by([(c, "ascending") for c in order]).to_batches(max_chunksize=10_000)

    packs = rows.select(number.alias("to"), *rows.columns).mapInArrow(_packs, "to int, pack binary")
    return packs.repartitionById(n, F.col("to")).select("pack").mapInArrow(sorted_rows, schema)
