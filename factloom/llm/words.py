"""Whole-text tokenisation and hashing over Arrow buffers.

Everything works on the UTF-8 bytes of many documents at once: separators come
from a 256-entry table, all words are hashed together eight bytes at a time,
and runs of words are joined from shorter runs.  Nothing is cut off: a slice
always holds whole documents, one at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19

#: Bytes that end a word of ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that end a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: One odd multiplier a lane: hashes of different lanes are independent of each other.
_LANES = (U(0xD1342543DE82EF95), U(0xAF251AF3B0F025B5))
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Bytes of a word beyond which it is hashed by itself.
_LONG = 256


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def spans(buf: np.ndarray, bounds: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (one more entry than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    non = ~sep[buf]
    inner = bounds[(bounds > 0) & (bounds < len(buf))]
    first = non.copy()
    first[1:] &= ~non[:-1]
    first[inner] = non[inner]
    last = non.copy()
    last[:-1] &= ~non[1:]
    last[inner - 1] = non[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of the words, eight bytes after eight bytes, each step mixing all bits.

    Of words of one length up to eight bytes no two share a hash; others do by
    chance alone, and not in both lanes.  Nothing is linear in the bytes, so
    words built to cancel out do not.
    """
    size, odd = ends - starts, _LANES[lane]
    wide = np.zeros(len(buf) + 8, np.uint8)
    wide[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", wide, strides=(1,))
    h = mix((size.astype(U) + U(1)) * odd)
    h = mix(h ^ (eight[starts] & _KEEP[np.minimum(size, 8)]) * odd)
    more, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        h[more] = mix(h[more] ^ (eight[starts[more] + done] & _KEEP[np.minimum(size[more] - done, 8)]) * odd)
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def gram_hashes(words: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, also those that cross rows (see ``whole_grams``).

    Runs of 1, 2, 4 .. words are joined from their halves, and ``n`` from
    those; every joint mixes all bits, so the order of words always counts.
    """
    if n < 1 or len(words) < n:
        return np.zeros(0, U)
    odd = _LANES[lane]
    out, done, run, size = None, 0, words, 1
    while True:
        if n & size:
            out = run if out is None else mix(out[: len(run) - done] * odd + run[done:])
            done += size
        if done == n:
            return out[: len(words) - n + 1] if n > 1 else mix(out * odd)
        run = mix(run[:-size] * odd + run[size:])
        size *= 2


def whole_grams(first: np.ndarray, n: int) -> np.ndarray:
    """Which runs of ``n`` words lie within one row; ``first`` as from ``spans``."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total - n + 1, bool)
    for k in range(1, n):
        cut = first[1:-1] - k
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok
