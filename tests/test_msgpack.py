"""MessagePack: bytes as its specification has them, read by another implementation, and rows that come back as they were."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest

from factloom.functions import values as V
from factloom.plans.store import FactStore
from factloom.sources import msgpack
from tests.test_operators import fact, ids, table  # noqa: F401

BYTES = [
    (None, "c0"), (True, "c3"), (False, "c2"), (0, "00"), (127, "7f"), (128, "cc80"), (256, "cd0100"), (1 << 16, "ce00010000"), ((1 << 63) - 1, "cf7fffffffffffffff"),
    (-1, "ff"), (-32, "e0"), (-33, "d0df"), (-128, "d080"), (-129, "d1ff7f"), (-40000, "d2ffff63c0"), (-1 << 63, "d38000000000000000"), (1.5, "cb3ff8000000000000"),
    ("", "a0"), ("é", "a2c3a9"), ("a" * 31, "bf" + "61" * 31), ("a" * 32, "d920" + "61" * 32), ("a" * 256, "da0100" + "61" * 256), ("a" * 65536, "db00010000" + "61" * 65536),
    ([], "90"), ([1, None], "9201c0"), ([1] * 16, "dc0010" + "01" * 16), ([1] * 65536, "dd00010000" + "01" * 65536), ({"a": 1, "b": None}, "81a16101"), ({f"k{i:02}": i for i in range(16)}, "de0010" + "".join(f"a36b{ord(f'{i:02}'[0]):x}{ord(f'{i:02}'[1]):x}{i:02x}" for i in range(16))),
    (datetime(1970, 1, 2), "d6ff00015180"), (datetime(2024, 1, 1, 0, 0, 0, 1), "d7ff00000fa0" + "65920080"), (datetime(1969, 12, 31, 23, 59, 59), "c70cff00000000ffffffffffffffff"),
]


def plain(x):
    """What ``read`` gives, as Python values."""
    if isinstance(x, dict):
        return {k.decode(): plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x.decode() if isinstance(x, bytes) else x


@pytest.mark.parametrize("value, text", BYTES, ids=lambda x: repr(x)[:20])
def test_bytes(value, text):
    kind = pa.struct([(k, pa.int64()) for k in value]) if isinstance(value, dict) else pa.timestamp("us") if isinstance(value, datetime) else pa.list_(pa.int64()) if isinstance(value, list) else None
    packed = msgpack._packed(pa.array([value], kind))[0] or b"\xc0"
    assert packed.hex() == text
    want = (value - datetime(1970, 1, 1)).total_seconds() * 1e6 if isinstance(value, datetime) else {k: v for k, v in value.items() if v is not None} if isinstance(value, dict) else value
    found, end = msgpack.read(packed)
    assert plain(found) == want and end == len(packed)


def test_what_others_write():
    assert msgpack.read(bytes.fromhex("ca3fc00000"))[0] == 1.5 and msgpack.read(bytes.fromhex("c4026162"))[0] == b"ab" and msgpack.read(bytes.fromhex("df00000001a161c0"))[0] == {b"a": None}
    for broken in ("c1", "a261", "d40100", "", "cb00", "81a161", "81a161a261", "0000", "9201"):
        with pytest.raises(ValueError):
            msgpack.whole(bytes.fromhex(broken))


def test_store_exports_messagepack(spark, table, tmp_path):  # noqa: F811
    """A fact a row, a map that another implementation reads, and the same facts when imported."""
    odd = fact("odd", objects=["@b", 2, float("inf"), -0.0, "x" * 70000, True, -(1 << 63)], attributes={"k": "ü", "n": 3}, start=datetime(1, 1, 1), end=datetime(9999, 12, 31, 23, 59, 59, 999999), metadata='{"a": "b"}')
    f = table(odd, fact("none"), fact("null") | {"objects": None, "attributes": [], "provenance": None, "context": None}, fact("gaps") | {"objects": [None, dict.fromkeys(V.VALUE.fieldNames())]}, *(fact(f"many{k}", objects=list(range(k))) for k in range(20)))
    FactStore.create(spark, str(tmp_path / "s"), f).export(str(tmp_path / "m"), "msgpack")
    other = FactStore.create(spark, str(tmp_path / "o"))
    other.import_(str(tmp_path / "m"), "msgpack")
    whole = lambda df: sorted(map(repr, df.drop("seq").collect()))
    assert whole(other.facts()) == whole(f)
    theirs = pytest.importorskip("pip._vendor.msgpack")
    rows = {r["fact_id"]: r for r in (theirs.unpackb(r.msgpack) for r in spark.read.parquet(str(tmp_path / "m")).collect())}
    assert sorted(rows) == ids(f)
    assert [rows["odd"][k].to_unix_nano() for k in ("valid_start", "valid_end")] == [-62135596800 * 10**9, 253402300799999999 * 1000]
    assert [next(v for k, v in o.items() if k not in ("kind", "type_hint")) for o in rows["odd"]["objects"]] == ["b", 2, float("inf"), -0.0, "x" * 70000, True, -(1 << 63)]
    assert "provenance" not in rows["null"] and rows["gaps"]["objects"] == [None, {}]
