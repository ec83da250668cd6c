"""Token counts of documents in flat, unindexed token files.

A token file is one run of fixed-width ids in which an end-of-document id ends
each document; nothing says where.  Files are read in blocks.  Each block
searches its ids for separators at once and keeps a few numbers: tokens before
the first separator, after the last, and between.  Documents that cross blocks
are stitched by a prefix scan over the blocks' numbers, in two levels, so that
a single huge file is scanned by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.chat import VOCABULARY, tokenizer
from factloom.llm.work import Workspace, partitions

#: End-of-document id of the default vocabulary, and the width of an id in a file.
EOD, DTYPE = 50256, "<u2"
#: Tokens of a block.
BLOCK = 1 << 19
#: Blocks of one first-level scan.
SUPER = 1024


def tokenise(docs: DataFrame, ws: Workspace, vocabulary: str = VOCABULARY, eod: int = EOD, dtype: str = DTYPE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` as token files; returns their blocks (file, block, data) and which documents they hold (file, part, ids).

    One file for each input partition; a block is ``block`` tokens of it, cut
    wherever it happens to end.  The second table only lists ids in order.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        file, made, part = TaskContext.get().partitionId(), 0, 0
        held, size, ids = [], 0, []

        def row(kind: int, number: int, data: bytes | None, names: list | None) -> pa.RecordBatch:
            cols = [([file], pa.int64()), ([kind], pa.int32()), ([number], pa.int64()), ([data], pa.binary()), ([names], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in cols], names=["file", "kind", "block", "data", "ids"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                held.append(np.array([*encode(t.as_py() or ""), eod], dtype))
                size += len(held[-1])
                ids.append(i)
                while size >= block:
                    flat = np.concatenate(held)
                    yield row(0, made, flat[:block].tobytes(), None)
                    held, size, made = [flat[block:]], size - block, made + 1
                if len(ids) >= 100_000:
                    yield row(1, part, None, ids)
                    ids, part = [], part + 1
        if size:
            yield row(0, made, np.concatenate(held).tobytes(), None)
        if ids:
            yield row(1, part, None, ids)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = slim.mapInArrow(write, "file long, kind int, block long, data binary, ids array<long>")
    path = ws.path("tokens")
    out.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    back = ws.spark.read.schema(out.schema).parquet(path)
    return back.where("kind = 0").select("file", "block", "data"), back.where("kind = 1").select("file", F.col("block").alias("part"), "ids")


def open_file(path: str):
    """A seekable file of any store pyarrow knows (local and mounted folders, HDFS, S3, GCS), by the path Spark lists it under."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        path = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def read_files(spark: SparkSession, path: str, dtype: str = DTYPE, block: int = BLOCK, opener: Callable = open_file) -> DataFrame:
    """Blocks (file, block, data) of the flat token files under ``path``.

    Spark only lists the files; each task then reads its blocks by their
    offsets, one at a time, so a file of any size is read by many tasks.
    ``opener`` opens a listed path on an executor.  Defined results: an empty
    file has no blocks; a file whose length is no multiple of an id's width
    raises, as its last id is not whole.
    """
    item = np.dtype(dtype).itemsize
    width = item * block

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, number, length in zip(*(c.to_pylist() for c in b.columns)):
                if length % item:
                    raise ValueError(f"{name}: {length} bytes are no whole number of ids of {item}")
                with opener(name) as f:
                    f.seek(number * width)
                    data = f.read(min(width, length - number * width))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / width).cast("long")
    ranges = files.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "length")
    return ranges.repartition(partitions(spark), "file", "block").mapInArrow(read, "file string, block long, data binary")


def separators(blocks: DataFrame, eod: int = EOD, dtype: str = DTYPE) -> DataFrame:
    """Each block's numbers: n tokens, n_sep separators, head before the first, tail after the last, lens between."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sep, head, tail, lens = [], [], [], [], []
            for data in b.column(2).to_pylist():
                ids = np.frombuffer(data, dtype)
                at = np.flatnonzero(ids == eod)
                n.append(len(ids))
                sep.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                lens.append(np.diff(at) - 1)
            cols = [(n, pa.int64()), (sep, pa.int64()), (head, pa.int64()), (tail, pa.int64()), (lens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, k) for v, k in cols)], names=["file", "block", "n", "n_sep", "head", "tail", "lens"])

    kind = dict(blocks.dtypes)["file"]
    return blocks.select("file", "block", "data").mapInArrow(search, f"file {kind}, block long, n long, n_sep long, head long, tail long, lens array<long>")


def count_tokens(blocks: DataFrame, ws: Workspace, eod: int = EOD, dtype: str = DTYPE) -> DataFrame:
    """One row per document in the files: file, ordinal, n_tokens, ended.

    Tokens after a file's last separator are a last document with ``ended``
    false.  Two separators in a row are an empty document.  An empty input
    gives an empty result; a null block holds no tokens.
    """
    found = separators(blocks.where("data is not null"), eod, dtype)
    found = ws.table(found.withColumn("super", F.floor(F.col("block") / SUPER)), "separators")
    # Position just after the last separator is the running maximum of those positions, so both scans are plain windows.
    near = W.partitionBy("file", "super").orderBy("block")
    before = near.rowsBetween(W.unboundedPreceding, -1)
    local = found.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"), F.coalesce(F.sum("n_sep").over(before), F.lit(0)).alias("o"))
    local = local.withColumn("e", F.when(F.col("n_sep") > 0, F.col("s") + F.col("n") - F.col("tail")))
    local = local.withColumn("e_before", F.max("e").over(before))
    far = W.partitionBy("file").orderBy("super")
    past = far.rowsBetween(W.unboundedPreceding, -1)
    supers = local.groupBy("file", "super").agg(F.sum("n").alias("n"), F.sum("n_sep").alias("n_sep"), F.max("e").alias("e"), F.max("block").alias("last_block"))
    supers = supers.select("file", "super", "e", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("ss"), F.coalesce(F.sum("n_sep").over(past), F.lit(0)).alias("so"), F.max("last_block").over(W.partitionBy("file")).alias("end_block"))
    supers = supers.withColumn("se", F.max(F.col("ss") + F.col("e")).over(past)).select("file", "super", "ss", "so", "se", "end_block")
    placed = local.join(supers, ["file", "super"])
    start = F.coalesce(F.greatest(F.col("ss") + F.col("e_before"), F.col("se")), F.lit(0))
    carry = F.col("ss") + F.col("s") - start
    placed = placed.select("file", "block", "n_sep", "head", "tail", "lens", (F.col("so") + F.col("o")).alias("first"), carry.alias("carry"), (F.col("block") == F.col("end_block")).alias("at_end"))
    whole = F.when(F.col("n_sep") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "lens")).otherwise(F.array().cast("array<bigint>"))
    ended = placed.select("file", "first", F.posexplode(whole).alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    open_ = placed.where("at_end").select("file", (F.col("first") + F.col("n_sep")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.union(open_)


def document_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, counted in token files written for them.

    Defined results: a null or empty text has no tokens; control strings are
    ordinary text; repeated rows are each counted; an empty input gives an
    empty result.  Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "token-counts")
    blocks, listed = tokenise(docs, ws, vocabulary, id_col=id_col, text_col=text_col)
    counted = count_tokens(blocks, ws)
    per = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    named = listed.select("file", "ids", F.coalesce(F.sum(F.size("ids")).over(per), F.lit(0)).alias("base"))
    named = named.select("file", "base", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    return named.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
