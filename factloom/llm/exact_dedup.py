"""Exact deduplication over a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z; a null text
counts as empty.  The steps, each bounded by its own partition:

1. every text is hashed where it lies (SHA-256 of the normalised UTF-8), and
   only digests travel from there on;
2. each input partition folds its digests in a :class:`CuckooIndex`, so that a
   group of copies, however large, leaves it as one row;
3. the folded rows meet by digest, in its order, and are folded again: the
   largest id stays, and a group that is complete is deleted from the index;
4. every row looks its group up by digest, an ordinary join whose hot keys
   adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.work import Workspace, partitions, spare_name


class CuckooIndex:
    """Digests in a cuckoo filter with the stored keys beside it.

    A filter slot holds a 16-bit fingerprint and the number of the entry it
    stands for.  A fingerprint that matches is only a hint: the entry's stored
    digest decides.  ``delete`` frees slot and entry.  An insertion that finds
    no free slot after ``KICKS`` moves doubles the filter and fills it again
    from the stored keys, so nothing is ever lost to an overflow.
    """

    WAYS, KICKS = 4, 200

    def __init__(self, capacity: int = 1 << 10):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self._free: list[int] = []
        self._size(max(2, 1 << (max(1, capacity // 3) - 1).bit_length()))

    def _size(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * buckets * self.WAYS))
        self.entries = array("q", bytes(8 * buckets * self.WAYS))

    def __len__(self) -> int:
        return len(self.keys) - len(self._free)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[2:10], "little") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) >> 3) & (self.buckets - 1)

    def _slot(self, key: bytes) -> int:
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * self.WAYS, bucket * self.WAYS + self.WAYS):
                if self.prints[slot] == mark and self.keys[self.entries[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """Number of the live entry that has this very digest, or -1."""
        slot = self._slot(key)
        return -1 if slot < 0 else self.entries[slot]

    def insert(self, key: bytes, value) -> int:
        """Add a digest that is not live and return its entry."""
        if self._free:
            entry = self._free.pop()
            self.keys[entry], self.values[entry] = key, value
        else:
            entry = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        if not self._settle(entry):
            self._grow()
        return entry

    def delete(self, key: bytes) -> bool:
        """Remove a live digest; False if there is none."""
        slot = self._slot(key)
        if slot < 0:
            return False
        entry = self.entries[slot]
        self.prints[slot] = 0
        self.keys[entry] = self.values[entry] = None
        self._free.append(entry)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values) if k is not None)

    def _settle(self, entry: int) -> bool:
        mark, one, two = self._place(self.keys[entry])
        for bucket in (one, two):
            for slot in range(bucket * self.WAYS, bucket * self.WAYS + self.WAYS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        bucket = two
        for turn in range(self.KICKS):
            slot = bucket * self.WAYS + (mark + turn) % self.WAYS
            mark, self.prints[slot] = self.prints[slot], mark
            entry, self.entries[slot] = self.entries[slot], entry
            bucket = self._other(bucket, mark)
            for slot in range(bucket * self.WAYS, bucket * self.WAYS + self.WAYS):
                if not self.prints[slot]:
                    self.prints[slot], self.entries[slot] = mark, entry
                    return True
        return False

    def _grow(self) -> None:
        while True:
            self._size(self.buckets * 2)
            if all(self._settle(e) for e, k in enumerate(self.keys) if k is not None):
                return


def fold(index: CuckooIndex, key: bytes, keep: int | None, rows: int) -> None:
    """Add ``rows`` copies, of which ``keep`` is the largest id, to the live group of ``key``."""
    at = index.find(key)
    if at < 0:
        index.insert(key, (keep, rows))
    else:
        had, n = index.values[at]
        index.values[at] = (had if keep is None else keep if had is None else max(had, keep), n + rows)


#: Live digests of one input partition before they are handed on; the groups meet again by digest.
HELD = 1 << 18

_FOLDED = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    batch: list = []
    for key, (keep, n) in index.items():
        batch.append((key, keep, n))
        if len(batch) == 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _FOLDED)], schema=_FOLDED)
            batch = []
    if batch:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*batch), _FOLDED)], schema=_FOLDED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        out = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "digest"])


def _fold_input(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        for i, key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            fold(index, key, i, n)
        if len(index) >= HELD:
            yield from _rows(index)
            index = CuckooIndex()
    yield from _rows(index)


def _fold_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by digest: only the last digest of a batch can go on, all others leave the index."""
    index = CuckooIndex()
    for b in batches:
        for key, i, n in zip(*(c.to_pylist() for c in b.columns)):
            fold(index, key, i, n)
        if b.num_rows:
            last = b.column(0)[b.num_rows - 1].as_py()
            open_ = index.values[index.find(last)]
            index.delete(last)
            yield from _rows(index)
            for done in [k for k, _ in index.items()]:
                index.delete(done)
            index.insert(last, open_)
    yield from _rows(index)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_rows.

    Defined results: a null text is an empty one, and empty texts are equal to
    each other.  Rows that repeat both id and text become one row; ``n_rows``
    counts them and ``group_size`` counts each of them.  A null id is smaller
    than every other and stays only where its whole group has none.  An empty
    input gives an empty result.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "exact-dedup")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = slim.mapInArrow(_digests, "doc_id long, digest binary").groupBy("doc_id", "digest").agg(F.count("*").alias("n_rows"))
    hashed = ws.table(hashed, "digests")
    shape = "digest binary, keep_id long, group_size long"
    folded = hashed.select("doc_id", "digest", "n_rows").mapInArrow(_fold_input, shape)
    groups = folded.repartition(partitions(spark, hashed), "digest").sortWithinPartitions("digest").mapInArrow(_fold_groups, shape)
    groups = ws.table(groups, "groups")
    return hashed.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_rows",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of repeated rows one stays."""
    sha, own, want, times = (spare_name(c, docs.columns) for c in ("sha", "stay_id", "stay_sha", "stay_rows"))
    found = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(want), F.col("n_rows").alias(times))
    marked = docs.mapInArrow(_with_sha(docs.columns.index(text_col), sha), docs.select("*", F.lit("").alias(sha)).schema)
    stay = marked.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.col(sha) == F.col(want)))
    once = stay.where(F.col(times) == 1)
    again = stay.where(F.col(times) > 1).dropDuplicates([id_col, sha])
    return once.unionByName(again).select(*docs.columns)


def _with_sha(at: int, name: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256((t.as_py() or b"").lower()).hexdigest() for t in b.column(at).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string())], names=[*b.schema.names, name])

    return add
