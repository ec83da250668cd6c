"""Half-open validity intervals and the bounds of temporal queries."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: str) -> datetime:
    """A bare year is its first of January; anything else is ISO, brought to UTC."""
    if re.fullmatch(r"\d{4}", text):
        return datetime(int(text), 1, 1)
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def bounds(start: str | None, end: str | None, whole_year: bool = True) -> tuple[datetime | None, datetime | None]:
    """Query bounds; a bare-year start without an end means that year unless ``whole_year`` is off."""
    lo = instant(start) if start is not None else None
    hi = instant(end) if end is not None else None
    if whole_year and hi is None and start is not None and re.fullmatch(r"\d{4}", start):
        hi = datetime(int(start) + 1, 1, 1)
    return lo, hi


def stamp(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def overlaps(start: Column, end: Column, lo: datetime | Column | None, hi: datetime | Column | None) -> Column:
    """[start, end) meets [lo, hi); an open end is null, a fact without a start never matches."""
    lo = stamp(lo) if isinstance(lo, datetime) else lo
    hi = stamp(hi) if isinstance(hi, datetime) else hi
    ok = start.isNotNull()
    if hi is not None:
        ok &= start < hi
    if lo is not None:
        ok &= end.isNull() | (end > lo)
    return ok


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    day = F.date_diff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(t)) * 60 + F.minute(t)) * 60_000_000 + second


def overlap_seconds(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Length of the strict overlap, null where there is none."""
    a, b = F.greatest(start, lo), F.least(F.coalesce(end, hi), hi)
    return F.when(a < b, (micros(b) - micros(a)) / F.lit(1e6))


def ends_after(start: Column, end: Column, t: datetime) -> Column:
    return start.isNotNull() & (end.isNull() | (end > stamp(t)))


def starts_before(start: Column, t: datetime) -> Column:
    return start < stamp(t)


def bucket(start: Column) -> Column:
    """Year of the start as text, ``atemporal`` without one."""
    return F.coalesce(F.year(start).cast("string"), F.lit("atemporal"))
