"""Benchmark decontamination by SimHash over item-sized windows.

For each number of words that benchmark items have, windows of that size slide
over every whole text.  A window's SimHash is looked up in one multi-index over
the fingerprints of all items of the size: the 64 bits are cut into RADIUS + 1
blocks, and fingerprints within RADIUS agree in a block at least, so no item
within the radius is missed.  What the index proposes is confirmed by the exact
weighted Jaccard similarity of the word shingles, each weighing as often as it
occurs.  A text of fewer words than the item is one window by itself.

A window without a shingle of any item has similarity 0 with all of them and is
not hashed.  Where shingles do not repeat, similarity 0.8 leaves two
fingerprints 9.7 of 64 bits apart with a deviation of 2.9, so RADIUS loses one
in 1e8; where they do repeat, in the window or in the item, fingerprints say
less, and the pair is confirmed whatever its distance.

Documents are scanned where they lie; items are sent to them in blocks of
bounded size, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import LOWER, NOT_ALNUM, U, gram_hashes, mix, slices, spans, whole_grams, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 28
#: Words of the items that one pass over the documents looks for: some 30 bytes each in every Python worker.
ITEM_WORDS = 1_000_000
#: Shingles of a text whose running sums are held at once.
REGION = 1 << 14

_EDGES = np.linspace(0, 64, RADIUS + 2).astype(int)


def _shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Shingle hashes of one text; with fewer words, one of all of them."""
    if len(words) >= n:
        return gram_hashes(words, n)
    return mix(gram_hashes(words, len(words)) + U(len(words))) if len(words) else np.zeros(0, U)


def simhash(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles that begin at ``starts``, ascending, as rows of 64 bits."""
    out = np.zeros((len(starts), 64), bool)
    lo = 0
    while lo < len(starts):
        hi = int(np.searchsorted(starts, starts[lo] + max(1, REGION - size), "left"))
        part = shingles[starts[lo] : starts[hi - 1] + size]
        bits = np.unpackbits(mix(part).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        at = starts[lo:hi] - starts[lo]
        out[lo:hi] = sums[at + size] > sums[at]
        lo = hi
    return out


def repeating(shingles: np.ndarray, size: int) -> np.ndarray:
    """For every window of ``size`` shingles whether one of them occurs twice in it."""
    order = np.argsort(shingles, kind="stable")
    before = np.full(len(shingles), -1, np.int64)
    same = np.flatnonzero(shingles[order][1:] == shingles[order][:-1])
    before[order[same + 1]] = order[same]
    # The largest place of an earlier twin in the window, by windows of 1, 2, 4 .. places.
    span = 1
    while span * 2 <= size:
        before = np.maximum(before[:-span], before[span:])
        span *= 2
    starts = np.arange(len(shingles) - size + 1)
    return np.maximum(before[starts], before[starts + size - span]) >= starts


class MultiIndex:
    """Fingerprints by the values of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.tables = []
        for lo, hi in zip(_EDGES[:-1], _EDGES[1:]):
            table = np.zeros((1 << (hi - lo), len(prints)), bool)
            table[self._value(prints, lo, hi), np.arange(len(prints))] = True
            self.tables.append(table)

    @staticmethod
    def _value(bits: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return bits[:, lo:hi] @ (1 << np.arange(hi - lo))

    def near(self, bits: np.ndarray, held: int) -> np.ndarray:
        """Which of ``bits`` are within RADIUS of one fingerprint held: blocks propose, the distance decides."""
        met = np.zeros(len(bits), bool)
        for table, lo, hi in zip(self.tables, _EDGES[:-1], _EDGES[1:]):
            met |= table[self._value(bits, lo, hi), held]
        at = np.flatnonzero(met)
        met[at] = (bits[at] != self.prints[held]).sum(axis=1) <= RADIUS
        return met


@dataclass
class Items:
    """One block of the benchmark: items with their shingles and counts, and where to look them up."""

    ids: list[int]
    words: np.ndarray
    sets: list[tuple[np.ndarray, np.ndarray]]
    keys: np.ndarray  # distinct shingles of all items, ascending
    owners: np.ndarray  # items of each key, key after key
    first: np.ndarray  # where a key's owners begin, and the end
    groups: dict[int, tuple[np.ndarray, MultiIndex, np.ndarray]]  # by number of words: items, their fingerprints, whether shingles repeat

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], n: int = SHINGLE) -> Items:
        ids, size, sets, prints = [], [], [], []
        for i, text in rows:
            for _, _, buf, bounds in slices(pa.array([text], pa.string())):
                buf = LOWER[buf]
                words = word_hashes(buf, *spans(buf, bounds, NOT_ALNUM)[:2])
                if not len(words):
                    continue
                s = _shingles(words, n)
                ids.append(i)
                size.append(len(words))
                sets.append(np.unique(s, return_counts=True))
                prints.append(simhash(s, np.array([0]), len(s))[0])
        keys = np.concatenate([u for u, _ in sets]) if sets else np.zeros(0, U)
        of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(u) for u, _ in sets])
        order = np.argsort(keys, kind="stable")
        distinct, counts = np.unique(keys, return_counts=True)
        length, groups = np.array(size, np.int64), {}
        for words in set(size):
            own = np.flatnonzero(length == words)
            groups[words] = own, MultiIndex(np.array([prints[k] for k in own])), np.array([(sets[k][1] > 1).any() for k in own])
        return cls(ids, length, sets, distinct, of[order], np.concatenate([[0], np.cumsum(counts)]), groups)

    def of_keys(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The owners of each of ``keys`` (all known), and which key each is of."""
        at = np.searchsorted(self.keys, keys)
        lo, n = self.first[at], self.first[at + 1] - self.first[at]
        which = np.repeat(np.arange(len(keys)), n)
        return self.owners[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]], which


def _weighted(window: np.ndarray, item: tuple[np.ndarray, np.ndarray]) -> float:
    u, c = np.unique(window, return_counts=True)
    both = np.intersect1d(u, item[0], assume_unique=True)
    less = np.minimum(c[np.searchsorted(u, both)], item[1][np.searchsorted(item[0], both)]).sum()
    return float(less / (c.sum() + item[1].sum() - less))


def scan_text(n_words: int, grams: dict[int, np.ndarray], hit: dict[int, np.ndarray], items: Items, n: int, least: float) -> Iterator[tuple[int, int, int, float, int]]:
    """(item, start, words, similarity, distance) of the best confirmed window of each item in one text."""
    for size, at in hit.items():
        if not len(at):
            continue
        g = grams[size]
        owner, which = items.of_keys(g[at])
        fits = np.minimum(items.words[owner], n) == size
        owner, place = owner[fits], at[which[fits]]
        for length in np.unique(items.words[owner]).tolist():
            ours = items.words[owner] == length
            own, places = owner[ours], place[ours]
            m = min(length - size + 1, len(g))  # a text of fewer words than the item is one window by itself
            marks = np.zeros(len(g) + 1, np.int64)
            marks[places + 1] = 1
            sums = np.cumsum(marks)
            starts = np.flatnonzero(sums[m:] > sums[: len(sums) - m])
            group, index, twice = items.groups[length]
            bits = again = None
            # Only an item of whose shingles enough stand in one window can be similar: the others' windows are not asked about.
            need = least * (length - size + 1)
            sort = np.argsort(own, kind="stable")
            own, places = own[sort], places[sort]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < need:
                    continue
                k, held = int(own[lo]), np.unique(places[lo:hi])
                w = np.flatnonzero(np.searchsorted(held, starts + m) - np.searchsorted(held, starts) >= need)
                if not len(w):
                    continue
                if bits is None:
                    bits, again = simhash(g, starts, m), repeating(g, m)[starts]
                j = int(np.searchsorted(group, k))
                w = w[index.near(bits[w], j) | again[w] | twice[j]]
                best = None
                for x in w.tolist():
                    s = _weighted(g[starts[x] : starts[x] + m], items.sets[k])
                    if s >= least and (best is None or s > best[1]):
                        best = (x, s)
                if best:
                    yield k, int(starts[best[0]]), min(length, n_words), best[1], int((bits[best[0]] != index.prints[j]).sum())


def _hits(texts: pa.Array, items: Items, n: int, least: float) -> Iterator[tuple[int, int, int, int, float, int]]:
    """(row, item, start, words, similarity, distance) over a column of texts."""
    sizes = sorted({min(n, int(w)) for w in items.words})
    for lo, _, buf, bounds in slices(texts):
        buf = LOWER[buf]
        starts, ends, first = spans(buf, bounds, NOT_ALNUM)
        words = word_hashes(buf, starts, ends)
        every, found = {}, {}
        for size in sizes:
            g = gram_hashes(words, n) if size == n else mix(gram_hashes(words, size) + U(size))
            ok = whole_grams(first, size)
            at = np.minimum(np.searchsorted(items.keys, g), len(items.keys) - 1)
            every[size], found[size] = g, np.flatnonzero(ok & (items.keys[at] == g))
        rows = np.unique(np.concatenate([np.searchsorted(first, f, "right") - 1 for f in found.values()]) if found else np.zeros(0, np.int64))
        for r in rows.tolist():
            a, z = int(first[r]), int(first[r + 1])
            grams = {s: g[a : max(a, z - s + 1)] for s, g in every.items()}
            hit = {s: f[np.searchsorted(f, a) : np.searchsorted(f, z)] - a for s, f in found.items()}
            for k, start, length, sim, dist in scan_text(z - a, grams, hit, items, n, least):
                yield lo + r, k, start, length, sim, dist


def item_blocks(benchmark: DataFrame, most: int = ITEM_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The benchmark's rows in blocks of about ``most`` words, one pass over the documents for each."""
    rows, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        rows.append((r["i"], r["t"]))
        held += len((r["t"] or "").split())
        if held >= most:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


_FOUND = "doc_id long, item_id long, first_word long, n_words long, similarity double, distance int"


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, least: float = SIMILARITY, most: int = ITEM_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The contaminated documents: one row per document and item with the best window.

    Defined results: null and empty texts, and items without words, match
    nothing; an item of fewer than ``n`` words is one shingle; a text of fewer
    words than the item is compared as a whole; items are
    reported one by one, also equal ones; the first of equally good windows
    counts; repeated rows of ``docs`` are each reported; an empty table on
    either side gives an empty result.  Other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for rows in item_blocks(benchmark, most, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows, n))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                got = list(_hits(b.column(1), items, n, least)) if items.ids else []
                ids = b.column(0).to_pylist()
                cols = [[ids[g[0]] for g in got], [items.ids[g[1]] for g in got], *([g[c] for g in got] for c in range(2, 6))]
                kinds = [pa.int64()] * 4 + [pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in _FOUND.split(", ")])

        part = slim.mapInArrow(find, _FOUND)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], _FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SHINGLE, least: float = SIMILARITY, most: int = ITEM_WORDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns."""
    at = docs.columns.index(text_col)
    for rows in item_blocks(benchmark, most):
        shared = docs.sparkSession.sparkContext.broadcast(Items.of(rows, n))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                if items.ids:
                    bad[[g[0] for g in _hits(b.column(at), items, n, least)]] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
