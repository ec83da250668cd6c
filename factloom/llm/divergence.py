"""How each source of a language differs in its words from the language's others.

Tasks count the terms of whole texts and send sums.  Counts of the terms a
language keeps are cut into dense tiles of int64, sources of one or two chunks
by the terms of one block; a tile compares all its pairs of sources by
broadcasting and reports one partial sum a pair and, for each source, a heap of
its best terms.  Partial sums add up, heaps merge under a limit a group.

A tile has at most about 2 * ``SOURCES`` * ``TERMS`` cells however many sources
and terms there are: sources and terms are dealt to chunks and blocks by hash,
as many as their numbers ask for.  What is quadratic in the sources of a
language is the result itself.

Defined results: null text, lang and source are empty strings; every row counts
as a document, repeated ones too; a group without kept terms counts 0 of each; a
language without kept terms has pairs of value 0 and no terms; ties are ordered
by the item's UTF-8 bytes; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.work import Workspace, partitions

MIN_DOCUMENTS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Sources of a chunk and terms of a block.
SOURCES, TERMS = 128, 2048
#: Terms that a task counts before it sends them on, and cells of one broadcast difference.
HELD, CELLS = 300_000, 1 << 20

#: A-Z in lower case, and a space for every byte that ends a term of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()

COUNTS = "lang string, source string, term string, n long, docs long"
TILE = "lang string, source string, other string, term string, value long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of some rows; a row of a null term stands for the group."""

    def flush() -> pa.RecordBatch:
        rows = [(lang, source, None, 0, 0) for lang, source in held]
        rows += [(lang, source, t.decode(), n, docs[lang, source][t]) for (lang, source), terms in held.items() for t, n in terms.items()]
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["lang", "source", "term", "n", "docs"])

    held: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3))):
            group = lang.as_py() or "", source.as_py() or ""
            if group not in held:
                held[group], docs[group] = Counter(), Counter()
                size += 1
            before = len(held[group])
            words = (text.as_py() or "").encode().translate(_TERMS).split(b" ")
            found = Counter(words)
            found.pop(b"", None)
            held[group].update(found)
            docs[group].update(found.keys())
            size += len(held[group]) - before
            if size > HELD:
                yield flush()
                held, docs, size = {}, {}, 0
    if held:
        yield flush()


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total, exact while 1000 * total fits 63 bits."""
    out, rest = np.zeros_like(count), count.copy()
    for _ in range(3):  # SCALE is 1000 three times
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def compare(key: tuple, cells: pa.Table, heads: pa.Table) -> pa.Table:
    """One tile: partial sums of all its pairs (other is set), and the best terms of its sources (term is set)."""
    lang, _, a, b = (k.as_py() for k in key)
    sources, chunk = heads["source"].to_pylist(), np.array(heads["chunk"].to_pylist(), np.int64)
    order = np.lexsort((np.arange(len(sources)), chunk != a))  # the first chunk's sources, then the second's
    sources, chunk = [sources[k] for k in order], chunk[order]
    own, kept = heads["n"].to_numpy()[order], int(heads["kept"][0].as_py())
    row_of = {s: k for k, s in enumerate(sources)}
    terms = sorted(set(cells["term"].to_pylist()), key=str.encode)
    col_of = {t: k for k, t in enumerate(terms)}
    count = np.zeros((len(sources), len(terms)), np.int64)
    whole = np.zeros(len(terms), np.int64)
    rows, cols = [row_of[s] for s in cells["source"].to_pylist()], [col_of[t] for t in cells["term"].to_pylist()]
    count[rows, cols] = cells["n"].to_numpy()
    whole[cols] = cells["whole"].to_numpy()
    p = scaled(count + SMOOTH, (own + SMOOTH * kept)[:, None]) if terms else count
    # Kept terms of the block that no source here has: all of them give a source the same p.
    absent = int(heads["terms"][0].as_py()) - len(terms)
    bare = scaled(np.full(len(sources), SMOOTH, np.int64), np.maximum(own + SMOOTH * kept, 1)) if absent else own * 0
    out: list[tuple] = []
    left = np.flatnonzero(chunk == a)
    step = max(1, CELLS // max(1, len(sources) * len(terms)))
    for lo in range(0, len(left), step):
        i = left[lo : lo + step]
        sums = np.abs(p[i][:, None, :] - p[None, :, :]).sum(axis=2) + absent * np.abs(bare[i][:, None] - bare[None, :])
        for x, line in zip(i, sums):
            for y in range(x + 1, len(sources)) if a == b else np.flatnonzero(chunk == b):
                out.append((lang, sources[x], sources[y], None, int(line[y])))
    if a == b and terms:
        q = scaled(whole + SMOOTH, np.full(len(terms), int(heads["total"][0].as_py()) + SMOOTH * kept))
        for x, s in enumerate(sources):
            more = np.flatnonzero((count[x] > 0) & (p[x] > q))
            gain = (p[x] - q)[more]
            for k in heapq.nsmallest(TOP, range(len(more)), key=lambda k: (-gain[k], more[k])):  # terms are in UTF-8 order
                out.append((lang, s, None, terms[more[k]], int(gain[k])))
    kinds = [pa.string()] * 4 + [pa.int64()]
    names = ["lang", "source", "other", "term", "value"]
    return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(zip(names, kinds))})


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources, ``term`` the 50 terms most above the language's share."""
    spark = docs.sparkSession
    ws = Workspace(spark, "divergence")
    counted = docs.select("lang", "source", "text").mapInArrow(count_terms, COUNTS)
    counts = ws.table(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs"))
    terms = ws.table(terms.where(F.col("docs") >= least).select("lang", "term", "whole"), "terms")
    kept = ws.table(counts.where("term is not null").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "kept")
    groups = counts.where("term is null").select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    own = groups.join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    # A language is its number of kept terms, of sources and of occurrences, and as many blocks and chunks as those ask for.
    langs = own.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("total"))
    size = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    langs = langs.join(size, "lang", "left").select("lang", "total", F.coalesce("kept", F.lit(0)).alias("kept"), F.ceil(F.col("sources") / SOURCES).alias("chunks"))
    langs = ws.table(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS))), "langs")

    chunk = F.pmod(F.xxhash64("source"), F.col("chunks")).alias("chunk")
    pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("a"), F.greatest("chunk", o).alias("b"))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block")
    many = terms.join(langs, "lang").groupBy("lang", block).agg(F.count("*").alias("terms"))
    tiled = lambda df: df.withColumn("t", pairs).select("*", "t.a", "t.b").drop("t")
    cells = tiled(kept.join(langs, "lang").select("lang", "source", "term", kept["n"], "whole", "chunks", block, chunk))
    heads = own.join(langs, "lang").select("lang", "source", own["n"], "total", "kept", "chunks", chunk, every).join(many, ["lang", "block"], "left")
    heads = tiled(heads.withColumn("terms", F.coalesce("terms", F.lit(0))))
    key = ["lang", "block", "a", "b"]
    cells, heads = (x.drop("chunks").repartition(partitions(spark), *key) for x in (cells, heads))
    tiles = cells.groupBy(*key).cogroup(heads.groupBy(*key)).applyInArrow(compare, TILE)
    found = ws.table(tiles, "tiles")
    ws.drop("counts", "terms", "kept", "langs")

    half = found.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pair = half.select("lang", "source", F.col("other").alias("item"), "value").union(half.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "value"))
    best = found.where("term is not null").select("lang", "source", F.col("term").alias("item"), "value")
    out = _ranked(pair).withColumn("part", F.lit("pair")).unionByName(_ranked(best).where(F.col("rank") <= TOP).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
