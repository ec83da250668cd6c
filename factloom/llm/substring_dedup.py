"""Substring deduplication with fixed-block anchors.

A word goes if it is covered by a run of ``window`` words that also starts
earlier in the corpus (smaller id, or same document and smaller position).

Any such run holds, where it stands first, a whole block of ``window // 2``
words out of the non-overlapping blocks its document is cut into.  So:

1. documents are packed, in the order of their ids, into small chunks
   (one written table; a chunk's number orders its documents);
2. every chunk sends its rolling block-sized windows, once each, and which of
   them are reference blocks, to buckets of the hash space.  A bucket answers
   each chunk with one bit per hash: an anchor is live if it is a reference
   block somewhere and stands at two places at least;
3. live anchors are extended: only full windows around them are candidates.
   They meet by 128 bits, out of two independent hashes of every word, as
   exact copies meet by their digest; the chunk that comes first owns them;
4. the rest is removed, and what overlaps joins to maximal repeats.

What travels is sorted hashes, delta-coded, and bits back; a passage that
stands in a third of all documents is one entry per chunk.  A row holds the
keys that a chunk has for one bucket, as steps from the bucket's lower bound,
so a key costs some four bytes however many buckets there are; chunks and
buckets both grow with the root of the input, so rows do not get emptier than
that.  Every position of every document is looked up; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import SPACES, U, gram_hashes, spans, whole_grams, word_hashes
from factloom.llm.work import Workspace, estimated_bytes, partitions

WINDOW = 20
#: Text of one chunk, and words whose anchors share one bucket, of inputs up to ``SCALE`` bytes; both grow with the
#: root of what is beyond, up to ``GROWTH`` times.  A longer document is a chunk of its own; a bucket is some 40 bytes
#: a word in the one task that answers it.
CHUNK_BYTES, BUCKET_WORDS = 1 << 18, 4_000_000
SCALE, GROWTH = 32 << 30, 16
#: Bits of an anchor's hash that travel.  Two anchors that differ only beyond them are both extended, and part there.
KEY_BITS = 44

_CHUNKS = "chunk long, ids array<long>, sizes array<long>, data binary, n_words long"
_LIMIT = (1 << 32) - 1


def growth(size: int) -> float:
    """By how much chunks and buckets grow for an input of ``size`` bytes."""
    return min(GROWTH, max(1.0, (size / SCALE) ** 0.5))


def lower_bound(bucket: int, buckets: int) -> int:
    """The smallest anchor hash of a bucket."""
    return -(-(bucket << 32) // buckets) << (KEY_BITS - 32)


def pack_sorted(keys: np.ndarray, low: int = 0) -> bytes:
    """Ascending numbers from ``low`` on as 4-byte steps; a step of ``_LIMIT`` alone adds to the next one."""
    steps = np.diff(keys, prepend=U(low))
    if len(steps) and steps.max() >= _LIMIT:
        fill = (steps // U(_LIMIT)).astype(np.int64)
        out = np.full(len(steps) + int(fill.sum()), _LIMIT, "<u4")
        out[np.cumsum(fill + 1) - 1] = steps % U(_LIMIT)
        return out.tobytes()
    return steps.astype("<u4").tobytes()


def unpack_sorted(data: bytes, low: int = 0) -> np.ndarray:
    steps = np.frombuffer(data, "<u4")
    return np.cumsum(steps, dtype=U)[steps != _LIMIT] + U(low)


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(bool)


def _cuts(high: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending 32-bit numbers, and the end."""
    return np.searchsorted((high * U(buckets)) >> U(32), np.arange(buckets + 1, dtype=U))


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    made, part = 0, TaskContext.get().partitionId()
    ids, texts, size = [], [], 0
    squeeze = zstandard.ZstdCompressor(level=3)

    def flush() -> pa.RecordBatch:
        nonlocal made, ids, texts, size
        data = b"".join(texts)
        sizes = [len(t) for t in texts]
        words = int(spans(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), SPACES)[2][-1])
        row = [[part << 32 | made], [ids], [sizes], [squeeze.compress(data)], [words]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        made, ids, texts, size = made + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["chunk", "ids", "sizes", "data", "n_words"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
            text = t.as_py() or b""
            if ids and size + len(text) > chunk_bytes:
                yield flush()
            ids.append(i)
            texts.append(text)
            size += len(text)
    if ids:
        yield flush()


class _Chunk:
    """The words of a chunk's documents and the hashes of their anchors."""

    def __init__(self, sizes: list[int], data: bytes, block: int):
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if data else np.zeros(0, np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.starts, self.ends, self.first = spans(self.buf, self.bounds, SPACES)
        self.words = word_hashes(self.buf, self.starts, self.ends)
        self.block = block
        self.at = np.flatnonzero(whole_grams(self.first, block))
        grams = gram_hashes(self.words, block)[self.at] >> U(64 - KEY_BITS)
        self.keys, self.of, self.times = np.unique(grams, return_inverse=True, return_counts=True)

    def reference(self) -> np.ndarray:
        """Which keys are reference blocks here."""
        doc = np.searchsorted(self.first, self.at, "right") - 1
        out = np.zeros(len(self.keys), bool)
        out[self.of[(self.at - self.first[doc]) % self.block == 0]] = True
        return out

    def candidates(self, answers: list[dict], buckets: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of full windows that hold a live anchor, their two hashes, and their order by hash."""
        cuts = _cuts(self.keys >> U(KEY_BITS - 32), buckets)
        live = np.zeros(len(self.keys), bool)
        for a in answers:
            lo, hi = cuts[a["bucket"]], cuts[a["bucket"] + 1]
            live[lo:hi] = _flags(a["bits"], hi - lo)
        marks = np.zeros(len(self.words) + 2, np.int32)
        marks[self.at + 1] = live[self.of]
        sums = np.cumsum(marks)
        whole = whole_grams(self.first, window)
        reach = window - self.block + 1
        if not len(whole) or not live.any():
            none = np.zeros(0, np.int64)
            return none, none.astype(U), none.astype(U), none
        last = np.minimum(np.arange(len(whole)) + reach, len(sums) - 1)
        starts = np.flatnonzero(whole & (sums[last] > sums[: len(whole)]))
        one = gram_hashes(self.words, window)[starts]
        two = gram_hashes(word_hashes(self.buf, self.starts, self.ends, 1), window, 1)[starts]
        return starts, one, two, np.lexsort((two, one))


def _firsts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which entries begin a group of equal pairs, in sorted order."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return new


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other: chunks are large, batches need not be held twice."""
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(i)[k].as_py() for i, name in enumerate(b.schema.names)}


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


_SENT = "bucket int, chunk long, n int, keys binary, more binary"
_SENT_NAMES, _SENT_KINDS = ["bucket", "chunk", "n", "keys", "more"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_ANSWER = "chunk long, bucket int, bits binary"


def _send_anchors(block: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row["sizes"], row["data"], block)
            ref, often, cuts = c.reference(), c.times > 1, _cuts(c.keys >> U(KEY_BITS - 32), buckets)
            full, cuts = np.flatnonzero(np.diff(cuts)).tolist(), cuts.tolist()
            yield _table(
                [(k, row["chunk"], cuts[k + 1] - cuts[k], pack_sorted(c.keys[cuts[k] : cuts[k + 1]], lower_bound(k, buckets)), _bits(np.concatenate([x[cuts[k] : cuts[k + 1]] for x in (ref, often)]))) for k in full],
                _SENT_NAMES,
                _SENT_KINDS,
            )

    return send


def _by_bucket(answer):
    """Runs ``answer`` on each bucket's rows.  A partition holds a bucket or a few, as packed bytes; only one at a time is unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, int, bytes, bytes]]] = {}
        for b in batches:
            for bucket, chunk, n, keys, more in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(bucket, []).append((chunk, n, keys, more))
        while held:
            bucket, rows = held.popitem()
            chunks, ns, keys, more = zip(*rows)
            out = answer(bucket, np.array(chunks, np.int64), np.array(ns, np.int64), keys, more)
            ends = np.cumsum(ns)
            told = [(c, bucket, _bits(out[e - n : e])) for c, n, e in zip(chunks, ns, ends.tolist()) if out[e - n : e].any()]
            yield _table(told, ["chunk", "bucket", "bits"], [pa.int64(), pa.int32(), pa.binary()])

    return run


def _answer_anchors(bucket: int, chunks: np.ndarray, ns: np.ndarray, packed: tuple[bytes, ...], more: tuple[bytes, ...]) -> np.ndarray:
    """Which entries are live; keys count from the bucket's lower bound."""
    keys = np.concatenate([unpack_sorted(x) for x in packed])
    both = [_flags(x, 2 * n) for x, n in zip(more, ns)]
    ref, often = np.concatenate([f[: len(f) // 2] for f in both]), np.concatenate([f[len(f) // 2 :] for f in both])
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(_firsts(keys[order], keys[order]))
    live = (np.add.reduceat(1 + often[order].astype(np.int64), new) > 1) & np.logical_or.reduceat(ref[order], new)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(live, np.diff(np.append(new, len(keys))))
    return out


def _send_windows(window: int, block: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["live"]:
                continue
            _, one, two, order = _Chunk(row["sizes"], row["data"], block).candidates(row["live"], buckets, window)
            one, two = one[order], two[order]
            new = _firsts(one, two)
            one, two = one[new], two[new]
            cuts = _cuts(one >> U(32), buckets)
            full, cuts = np.flatnonzero(np.diff(cuts)).tolist(), cuts.tolist()
            yield _table([(k, row["chunk"], cuts[k + 1] - cuts[k], *(x[cuts[k] : cuts[k + 1]].tobytes() for x in (one, two))) for k in full], _SENT_NAMES, _SENT_KINDS)

    return send


def _answer_windows(bucket: int, chunks: np.ndarray, ns: np.ndarray, ones: tuple[bytes, ...], twos: tuple[bytes, ...]) -> np.ndarray:
    """Which entries stand in an earlier chunk too."""
    one, two = (np.concatenate([np.frombuffer(x, U) for x in xs]) for xs in (ones, twos))
    chunk = np.repeat(chunks, ns)
    order = np.lexsort((chunk, two, one))
    later = np.zeros(len(one), bool)
    later[order] = ~_firsts(one[order], two[order])
    return later


_OUT = "doc_id long, n_words long, removed array<struct<first:long,last:long>>, kept_text string"
_SPAN = pa.struct([("first", pa.int64()), ("last", pa.int64())])


def _cut_out(window: int, block: int, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row["sizes"], row["data"], block)
            gone = np.zeros(len(c.words) + 1, np.int32)
            if row["live"]:
                starts, one, two, order = c.candidates(row["live"], buckets, window)
                one, two = one[order], two[order]
                new = _firsts(one, two)
                group = np.cumsum(new) - 1
                cuts = _cuts(one[new] >> U(32), buckets)
                later = np.zeros(int(new.sum()), bool)
                for a in row["later"] or ():
                    lo, hi = cuts[a["bucket"]], cuts[a["bucket"] + 1]
                    later[lo:hi] = _flags(a["bits"], hi - lo)
                drop = starts[order][~new | later[group]]
                np.add.at(gone, drop, 1)
                np.add.at(gone, drop + window, -1)
            yield _documents(row["ids"], c, np.cumsum(gone)[:-1] > 0)

    return cut


def _documents(ids: list, c: _Chunk, gone: np.ndarray) -> pa.RecordBatch:
    # Bytes to keep: kept words and, as a space, the byte after each (the last of a document has none).
    step = np.zeros(len(c.buf) + 2, np.int32)
    s, e = c.starts[~gone], c.ends[~gone]
    np.add.at(step, s, 1)
    np.add.at(step, e + 1, -1)
    take = np.cumsum(step)[: len(c.buf)] > 0
    text = c.buf.copy()
    inside = e[e < len(text)]
    text[inside] = 0x20
    # A word that ends its document takes no byte of the next one.
    tight = c.bounds[1:-1]
    touch = np.isin(tight, e) & ~np.isin(tight, s)
    text[tight] = c.buf[tight] if len(tight) else text[tight]
    take[tight[touch]] = False
    n = np.diff(c.first)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    rows = []
    for k, i in enumerate(ids):
        lo, hi = c.first[k], c.first[k + 1]
        near = runs[np.searchsorted(runs[:, 1], lo, "right") : np.searchsorted(runs[:, 0], hi)]
        cut = [{"first": int(max(a, lo) - lo), "last": int(min(z, hi) - lo - 1)} for a, z in near]
        x, y = c.bounds[k], c.bounds[k + 1]
        rows.append((i, int(n[k]), cut, text[x:y][take[x:y]].tobytes().decode().rstrip(" ")))
    return _table(rows, ["doc_id", "n_words", "removed", "kept_text"], [pa.int64(), pa.int64(), pa.list_(_SPAN), pa.string()])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, removed spans of word numbers, kept_text (kept words joined by one space).

    Defined results: a null text has no words; a text shorter than ``window``
    keeps all.  Rows that share an id follow each other in the order of their
    texts' hashes, so a repeated row loses what the one before it has; null
    ids come first.  An empty input gives an empty result.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    ws, block = Workspace(spark, "substring-dedup"), window // 2
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n, grown = partitions(spark, slim), growth(estimated_bytes(slim))
    chunk_bytes = int(CHUNK_BYTES * grown)
    # Rows of one id are told apart by their texts, and equal rows, of which any may come first, by chance.
    keys = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("spread")]
    ordered = slim.withColumns({"hash": F.xxhash64("text"), "spread": F.rand(11)}).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    chunks = ws.table(ordered.select("doc_id", "text").mapInArrow(partial(_pack, chunk_bytes=chunk_bytes), _CHUNKS), "chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(n, -(-words // int(BUCKET_WORDS * grown)))

    def gathered(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))

    sent = chunks.select("chunk", "sizes", "data").mapInArrow(_send_anchors(block, buckets), _SENT)
    live = ws.table(sent.repartition(buckets, "bucket").mapInArrow(_by_bucket(_answer_anchors), _ANSWER), "live")
    marked = chunks.select("chunk", "ids", "sizes", "data").join(gathered(live, "live"), "chunk", "left")
    sent = marked.drop("ids").mapInArrow(_send_windows(window, block, buckets), _SENT)
    later = ws.table(sent.repartition(buckets, "bucket").mapInArrow(_by_bucket(_answer_windows), _ANSWER), "later")
    return marked.join(gathered(later, "later"), "chunk", "left").mapInArrow(_cut_out(window, block, buckets), _OUT)
