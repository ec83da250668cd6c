"""MessagePack: rows as maps of their columns by name, nulls of a map left out, times as its timestamps.

Columns are packed one after the other, a value's bytes joined to its row's; what is read may come from any writer.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_FORMS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_NUMBERS = {t: (struct.Struct(f).unpack_from, struct.calcsize(f)) for t, f in _FORMS.items()}
#: First byte: bytes of the length that follows.
_TEXTS = {0xC4: 1, 0xC5: 2, 0xC6: 4, 0xD9: 1, 0xDA: 2, 0xDB: 4}
_MANY = {0xDC: 2, 0xDD: 4, 0xDE: 2, 0xDF: 4}
_EXTENSIONS = {0xC7: 1, 0xC8: 2, 0xC9: 4}
_CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}


def _head(n: int, small: int, most: int, *forms: int) -> bytes:
    """The first bytes of what has ``n`` bytes, items or pairs; ``forms`` are for lengths of one (texts alone), two and four bytes."""
    if n <= most:
        return bytes((small | n,))
    for form, width in zip(forms, (1, 2, 4)[3 - len(forms) :], strict=True):
        if n < 1 << 8 * width:
            return bytes((form,)) + n.to_bytes(width, "big")
    raise ValueError(f"{n} are too many for MessagePack")


def _text(x: bytes) -> bytes:
    return _head(len(x), 0xA0, 31, 0xD9, 0xDA, 0xDB) + x


def _integer(n: int) -> bytes:
    if -32 <= n < 128:
        return bytes((n & 0xFF,))
    for k, width in enumerate((1, 2, 4, 8)):
        if n < 0 and n >= -1 << 8 * width - 1:
            return bytes((0xD0 + k,)) + n.to_bytes(width, "big", signed=True)
        if 0 <= n < 1 << 8 * width:
            return bytes((0xCC + k,)) + n.to_bytes(width, "big")
    raise ValueError(n)


def _time(micros: int) -> bytes:
    s, us = divmod(micros, 1_000_000)
    if 0 <= s < 1 << 32 and not us:
        return b"\xd6\xff" + s.to_bytes(4, "big")
    if 0 <= s < 1 << 34:
        return b"\xd7\xff" + (us * 1000 << 34 | s).to_bytes(8, "big")
    return b"\xc7\x0c\xff" + (us * 1000).to_bytes(4, "big") + s.to_bytes(8, "big", signed=True)


def _each(values: pa.Array, pack: Callable) -> list[bytes | None]:
    """Packed values, those that repeat packed once."""
    coded = values.dictionary_encode()
    packed = [*(pack(x) for x in coded.dictionary.to_pylist()), None]
    return [packed[i] for i in coded.indices.fill_null(-1).to_numpy().tolist()]


def _known(values: pa.Array) -> list[bool]:
    return values.is_valid().to_numpy(zero_copy_only=False).tolist()


def _packed(values: pa.Array) -> list[bytes | None]:
    """What each value is in MessagePack, None for a null."""
    kind = values.type
    if values.null_count == len(values):
        return [None] * len(values)
    if pa.types.is_string(kind):
        return _each(values.cast(pa.binary()), _text)
    if pa.types.is_boolean(kind):
        return _each(values, lambda x: b"\xc3" if x else b"\xc2")
    if pa.types.is_timestamp(kind):
        return _each(values.cast(pa.timestamp("us", kind.tz)).cast(pa.int64()), _time)
    if pa.types.is_integer(kind):
        return _each(values, _integer)
    if pa.types.is_floating(kind):
        rows = np.full((len(values), 9), 0xCB, np.uint8)
        rows[:, 1:] = values.fill_null(0).to_numpy().astype(">f8").view(np.uint8).reshape(-1, 8)
        return [x if known else None for known, (x,) in zip(_known(values), struct.iter_unpack("9s", rows.tobytes()), strict=True)]
    there = _known(values)
    if pa.types.is_list(kind):
        items = [b"\xc0" if x is None else x for x in _packed(values.values)]
        return [_head(hi - lo, 0x90, 15, 0xDC, 0xDD) + b"".join(items[lo:hi]) if known else None for known, (lo, hi) in zip(there, pairwise(values.offsets.to_numpy().tolist()), strict=True)]
    if pa.types.is_struct(kind):
        names = [_text(f.name.encode()) for f in kind]
        fields = [[None if x is None else name + x for x in _packed(values.field(k))] for k, name in enumerate(names) if values.field(k).null_count < len(values)]
        rows = ([x for x in row if x is not None] for row in zip(*fields, strict=True)) if fields else ([] for _ in there)
        return [_head(len(row), 0x80, 15, 0xDE, 0xDF) + b"".join(row) if known else None for known, row in zip(there, rows, strict=True)]
    raise TypeError(f"{kind} has no form in MessagePack here")


def _read_time(kind: int, x: bytes) -> int:
    if kind != 0xFF or len(x) not in (4, 8, 12):
        raise ValueError("an extension that is no timestamp")
    n = int.from_bytes(x, "big")
    if len(x) == 4:
        return n * 1_000_000
    s, ns = (n & (1 << 34) - 1, n >> 34) if len(x) == 8 else (int.from_bytes(x[4:], "big", signed=True), n >> 64)
    return s * 1_000_000 + ns // 1000


def read(b: bytes, p: int = 0) -> tuple[object, int]:
    """The value at ``p`` and where it ends: texts as their bytes, times as microseconds since 1970."""
    t = b[p]
    p += 1
    if t in _NUMBERS:
        form, width = _NUMBERS[t]
        return form(b, p)[0], p + width
    if 0x80 <= t < 0x90 or t in (0xDE, 0xDF):
        n = t & 15
        if t > 0x8F:
            n, p = _length(b, p, _MANY[t])
        out = {}
        for _ in range(n):
            # short texts, which most names are and many values, are read here: a call each would take most of the time
            t = b[p]
            if 0xA0 <= t < 0xC0:
                key = b[p + 1 : (p := p + 1 + (t & 31))]
            else:
                key, p = read(b, p)
            t = b[p]
            if 0xA0 <= t < 0xC0:
                out[key] = b[p + 1 : (p := p + 1 + (t & 31))]
            else:
                out[key], p = read(b, p)
        return out, p
    if 0x90 <= t < 0xA0 or t in _MANY:
        n = t & 15
        if t > 0x9F:
            n, p = _length(b, p, _MANY[t])
        items = []
        for _ in range(n):
            item, p = read(b, p)
            items.append(item)
        return items, p
    if t < 0x80:
        return t, p
    if t >= 0xE0:
        return t - 256, p
    if t < 0xC0:
        return b[p : p + (t & 31)], p + (t & 31)
    if t in _CONSTANTS:
        return _CONSTANTS[t], p
    if t in _TEXTS:
        n, p = _length(b, p, _TEXTS[t])
        return b[p : p + n], p + n
    if t in _EXTENSIONS:
        n, p = _length(b, p, _EXTENSIONS[t])
    elif 0xD4 <= t <= 0xD8:
        n = 1 << t - 0xD4
    else:
        raise ValueError(f"no MessagePack begins with {t:#x}")
    return _read_time(b[p], b[p + 1 : p + 1 + n]), p + 1 + n


def _length(b: bytes, p: int, width: int) -> tuple[int, int]:
    return int.from_bytes(b[p : p + width], "big"), p + width


def whole(b: bytes) -> object:
    """The one value that ``b`` is; ends that are too early or too late raise."""
    try:
        value, end = read(b)
    except (IndexError, struct.error):
        end = None
    if end != len(b):
        raise ValueError("not one whole value of MessagePack")
    return value


def pack(rows: DataFrame) -> DataFrame:
    """(msgpack): each row as a map."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_packed(b.to_struct_array()), pa.binary())], names=["msgpack"])

    return rows.mapInArrow(run, "msgpack binary")


def unpack(packed: DataFrame, schema: StructType) -> DataFrame:
    """Rows of ``schema`` out of (msgpack); names that a map does not have are nulls."""
    kind = pa.struct(to_arrow_schema(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_struct_array(pa.array([whole(x) for x in b.column(0).to_pylist()], kind))

    return packed.select("msgpack").mapInArrow(run, schema)
