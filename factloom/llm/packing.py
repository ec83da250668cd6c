"""Packing documents into training sequences of equal cost.

Documents are encoded, ended with one id, and packed a unit at a time, a unit
being a run of one task's documents of about ``UNIT_TOKENS`` ids.  A unit of n
ids opens n // length sequences and, for what is left, one of each power of two
in it; so every sequence is filled exactly and none needs padding.  Pieces go
in descending order to the sequence of the lowest estimated cost (linear plus
quadratic attention) that has room; only what has room nowhere is cut.

Nothing is shuffled and nothing is gathered: a task holds the ids of one unit
and of the document it reads.  A task that is run again deals the same ids.

Defined results: a null text is an empty one, a document of the end id alone;
every row is a document of its own, also one that repeats another or has a null
id; an empty table gives an empty one; a text of any length is cut into whole
sequences first; other columns are not read.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.words import SPACES, word_hashes

LENGTH = 2048
END = 1
#: Ids of a unit: 512 sequences of ``LENGTH``.
UNIT_TOKENS = 1 << 20
#: Tokens at which the quadratic part of a document's cost equals the linear one: six times a width of 1024.
EVEN_AT = 6144
#: Words whose ids a worker remembers, and the longest of them in bytes.
KNOWN_WORDS, KNOWN_BYTES = 1_000_000, 64
#: Ids of one record batch of the result.
BATCH_IDS = 1 << 20
#: Bytes of texts that are encoded together.
RUN_BYTES = 1 << 21

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    """Ids of whole texts.

    The vocabulary's rules never join what white space parts, nor ASCII
    punctuation (but for apostrophes) with the ASCII letter or digit beside it.
    So a text's ids are those of its words and of the punctuation beside them,
    one after the other; each of these is encoded once and then remembered.
    Case is folded beforehand.  A text that can hold a combining mark or the
    name of a special id is cut at white space alone, and its case is left.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)
        self.used = self.count = 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Places for the ids of words of these sizes."""
        k, end = self.count, self.used + len(ids)
        while len(self.ids) < end:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.first) < k + len(sizes) + 1:
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.ids[self.used : end] = ids
        self.first[k + 1 : k + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.count = end, k + len(sizes)
        return range(k, self.count)

    def _keep(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(words, self._add(ids, sizes)))

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters alone are one unit each and go in as one text: each unit's last id says that it ends."""
        texts = [w.decode() for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(texts[k] for k in plain)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(plain):
                self._keep([words[k] for k in plain], ids, np.diff(stops, prepend=0))
            else:
                plain = []
        rest = [w for w in words if w not in self.place] if plain else words
        if rest:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(rest, np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and how many each has."""
        lo, size = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.cumsum(size)
        return self.ids[np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size

    def _places(self, words: list[bytes]) -> tuple[list[int], tuple[int, int]]:
        """Where the ids of different words are; and how full the table is without words too long to be kept."""
        long = [(k, w) for k, w in enumerate(words) if len(w) > KNOWN_BYTES]
        for k, _ in long:
            words[k] = b"a"  # any short word, until its own ids are there
        at = list(map(self.place.get, words))
        if fresh := [w for w, k in zip(words, at) if k is None]:
            if len(self.place) + len(fresh) > KNOWN_WORDS:
                self._forget()
                fresh = list(dict.fromkeys(words))
            self._encode(fresh)
            at = list(map(self.place.__getitem__, words))
        mark = self.used, self.count
        for k, w in long:
            ids = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32)
            at[k] = self._add(ids, np.array([len(ids)]))[0]
        return at, mark

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        own = [(t or "").encode() for t in texts]
        careful = [b"\xcc" in d or b"\xcd" in d or b"<|" in d for d in own]
        data = b" ".join(d if c else d.lower() for d, c in zip(own, careful))
        buf = np.frombuffer(data, np.uint8)
        bounds = np.cumsum([0, *(len(d) + 1 for d in own)])
        starts, ends = _cut(buf, [(bounds[k], bounds[k + 1]) for k, c in enumerate(careful) if c])
        if not len(starts):
            return [np.zeros(0, np.uint32)] * len(texts)
        one, two = word_hashes(buf, starts, ends), word_hashes(buf, starts, ends, 1)
        _, rep, back = np.unique(one, return_index=True, return_inverse=True)
        if (two[rep][back] != two).any():  # two words of one hash: each word by itself
            rep = back = np.arange(len(starts))
        words = [data[s:e] for s, e in zip(starts[rep].tolist(), ends[rep].tolist())]
        at, mark = self._places(words)
        ids, size = self._gather(np.array(at, np.int64)[back])
        self.used, self.count = mark
        cuts = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, bounds[1:-1])]
        return np.split(ids, cuts)


#: 1 for ASCII letters and digits, 2 for ASCII punctuation that never joins them.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list((string.ascii_letters + string.digits).encode())] = 1
_CLASS[list(string.punctuation.replace("'", "").encode())] = 2


def _cut(buf: np.ndarray, whole: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what is encoded by itself; within the ranges ``whole`` only white space cuts."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, kind = ~SPACES[buf], _CLASS[buf]
    joint = (kind[1:] | kind[:-1]) != 3
    for lo, hi in whole:
        joint[lo : hi - 1] = True
    joint &= inside[1:] & inside[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joint
    last[:-1] &= ~joint
    return np.flatnonzero(first), np.flatnonzero(last) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def capacities(tokens: int, length: int) -> list[int]:
    """Sequences that ``tokens`` ids fill exactly: full ones, then the powers of two in the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(sizes: np.ndarray, length: int = LENGTH, even_at: int = EVEN_AT) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of ``sizes`` ids; sequences from 0."""
    whole = sizes // length
    out = [(int(d), int(k) * length, length, 0, 0) for d in np.flatnonzero(whole) for k in range(whole[d])]
    out = [(d, s, n, q, 0) for q, (d, s, n, _, _) in enumerate(out)]
    full, rest = len(out), sizes - whole * length
    room = np.array(capacities(int(rest.sum()), length), np.int64)
    filled, cost = np.zeros_like(room), np.zeros(len(room))
    for d in np.lexsort((np.arange(len(rest)), -rest)):
        at, left = int(whole[d]) * length, int(rest[d])
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            q = int(np.argmin(np.where(fits, cost, np.inf)))
            n = min(left, int(room[q]))
            out.append((int(d), at, n, full + q, int(filled[q])))
            room[q] -= n
            filled[q] += n
            cost[q] += n + n * n / even_at
            at, left = at + n, left - n
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, tokens, sequence, offset = zip(*rows)
    long = lambda x: pa.array(x, pa.int64())
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([long(doc), long(start), long([len(x) // 4 for x in ids]), pa.array(ids, pa.binary()), long(tokens), long(sequence), long(offset)], names=names)


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``RUN_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = held = 0
    for k, n in enumerate(sizes):
        held += int(n)
        if held >= RUN_BYTES:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, unit: int = UNIT_TOKENS, even_at: int = EVEN_AT, path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``length`` has to be a power of two for sequences to need no padding.
    ``sequence_id`` is the number of the input's partition, then a count within it.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        held, base, done, tokens = [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            sizes = np.fromiter((len(x) for _, x in held), np.int64, len(held))
            rows, many, last = [], 0, -1
            for d, start, n, q, offset in assign(sizes, length, even_at):
                doc, ids = held[d]
                rows.append((doc, start, ids[start : start + n].tobytes(), len(ids), base + done + q, offset))
                many, last = many + n, max(last, q)
                if many >= BATCH_IDS:
                    yield _batch(rows)
                    rows, many = [], 0
            if rows:
                yield _batch(rows)
            done += last + 1

        for batch in batches:
            for lo, hi in _runs(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                base = (part.column(2)[0].as_py() >> 33) << 40
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    held.append((doc, np.append(ids, np.uint32(end)).astype("<u4")))
                    tokens += len(held[-1][1])
                    if tokens >= unit:
                        yield from flush()
                        held, tokens = [], 0
        if held:
            yield from flush()

    # The id that Spark counts up within a partition names the partition, also where several share a task.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.monotonically_increasing_id().alias("place"))
    return rows.mapInArrow(run, SCHEMA)
