"""Bounded, repeatable samples of labelled rows for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Distinct labels that a model may have.
LABELS = 10_000


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def bounded(rows: DataFrame, label: str, most: int, by_label: bool) -> list:
    """At most ``most`` rows (for each label, or in all), chosen by the hash of their id and text.

    ``rows`` has doc_id, text and ``label``.  Labels are counted without
    reading texts; then only about as many rows as wanted are fetched, so rows
    of one id do not come all together.  More than ``LABELS`` labels raise.
    """
    found = rows.groupBy(label).count().limit(LABELS + 1).collect()
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} values of {label}")
    counts = {r[label]: r["count"] for r in found}
    whole = sum(counts.values())
    spin = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).cast("long")
    share = F.lit(0)
    for value, n in counts.items():
        cut = min(1.0, 1.2 * most / max(1, n if by_label else whole))
        share = F.when(F.col(label) == value, F.lit(int(cut * (1 << 30)))).otherwise(share)
    some = rows.withColumn("__spin", spin).where(F.col("__spin") < share)
    got = some.dropDuplicates(["doc_id", "__spin", label]).collect()  # equal rows hash alike, and teach once
    got.sort(key=lambda r: (r["__spin"], r["doc_id"] or 0, r["text"] or "", str(r[label])))
    out, used = [], {}
    for r in got:
        k = r[label] if by_label else None
        if used.get(k, 0) < most:
            used[k] = used.get(k, 0) + 1
            out.append(r)
    return out
