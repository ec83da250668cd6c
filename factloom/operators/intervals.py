"""Overlap join of two tables of half-open intervals.

[a, b) meets [c, d) if c lies in [a, b) or a lies in (c, d): two joins of
points with intervals, of which a pair takes part in one.  An interval is a few
cells of a binary hierarchy of bins (two a level at most, however long it is),
and a point is the cell that holds it on each level that intervals use: an
equi-join, after which the exact bounds decide.  Cells of many points are split
by a salt, as many ways as their level's fullest cell asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut
from factloom.functions.temporal import micros

DAY = 86_400_000_000
#: Points of one cell that a task joins.
CELL_POINTS = 1_000_000
_MAX = (1 << 63) - 1


def _cells(first: Column, last: Column, levels: int) -> Column:
    """(level, cell) of the fewest cells of the hierarchy that make up the bins from ``first`` to ``last``."""
    none = F.array().cast("array<struct<level:int,cell:bigint>>")

    def on(k: Column) -> Column:
        step = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
        low, high = F.call_function("shiftright", first + step(k) - 1, k), F.call_function("shiftright", last + 1, k)
        up = k + 1
        low_up, high_up = F.call_function("shiftright", first + step(up) - 1, up), F.call_function("shiftright", last + 1, up)
        own = F.when(low >= high, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array(low, high - 1)))
        own = F.filter(own, lambda c: ~((low_up < high_up) & (c >= 2 * low_up) & (c < 2 * high_up)))
        return F.transform(own, lambda c: F.struct(k.cast("int").alias("level"), c.alias("cell")))

    return F.coalesce(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), on)), none)


def _held(points: DataFrame, intervals: DataFrame, origin: int, bin_micros: int, levels: int, most: int) -> DataFrame:
    """Points (p, t) with the intervals (i, lo, hi) that hold them: lo <= t < hi."""
    number = lambda t: F.floor((t - origin) / F.lit(bin_micros)).cast("long")
    cells = intervals.select("i", "lo", "hi", F.explode(_cells(number(F.col("lo")), number(F.col("hi") - 1), levels)).alias("c")).select("i", "lo", "hi", "c.level", "c.cell")
    used = sorted(r.level for r in cells.select("level").distinct().collect())  # levels: fewer than 64
    binned = points.withColumn("bin", number(F.col("t")))
    up = lambda rows: rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("bin", k).alias("cell")) for k in used])).alias("c")).select("*", "c.level", "c.cell").drop("c", "bin")
    if not used:
        return points.select("p", F.lit(None).cast(intervals.schema["i"].dataType).alias("i")).limit(0)
    full = up(binned.groupBy("bin").agg(F.count("*").alias("n"))).groupBy("level", "cell").agg(F.sum("n").alias("n")).groupBy("level").agg(F.max("n").alias("n")).collect()
    salts = {r.level: -(-r.n // most) for r in full if r.n > most}
    ways = F.lit(1)
    for level, n in salts.items():
        ways = F.when(F.col("level") == level, n).otherwise(ways)
    at = up(binned).withColumn("salt", F.pmod(F.xxhash64("p", "t"), ways).cast("int"))
    cells = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), ways.cast("int") - 1)))
    return at.join(cells, ["level", "cell", "salt"]).where("lo <= t and t < hi").select("p", "i")


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], bin_micros: int = DAY, most: int = CELL_POINTS) -> DataFrame:
    """(left_id, right_id) of all pairs whose intervals [start, end) share a moment.

    The ends are timestamps without a zone; a null end is open, a null start or
    an end that is not after its start meets nothing.  Ids that repeat stand
    for rows that repeat: a pair comes once for each pair of rows.
    """
    one = lambda df, i, at: df.select(F.col(i).alias("i"), micros(F.col(at[0])).alias("lo"), F.coalesce(micros(F.col(at[1])), F.lit(_MAX)).alias("hi")).where("lo is not null and hi > lo")
    a, b = cut(one(left, left_id, left_at), "intervals"), cut(one(right, right_id, right_at), "intervals")
    ends = lambda c: F.when(F.col(c) < _MAX, F.col(c))
    seen = a.select("lo", "hi").union(b.select("lo", "hi")).agg(F.min("lo").alias("first"), F.max(F.greatest(F.col("lo") + 1, F.coalesce(ends("hi"), F.col("lo") + 1))).alias("last")).first()
    if seen.first is None:
        return a.select(F.col("i").alias(left_id), F.lit(None).cast(b.schema["i"].dataType).alias(right_id)).limit(0)
    # What is open ends with the last moment of either table: no start is later.
    clip = lambda df: df.withColumn("hi", F.least("hi", F.lit(seen.last)))
    a, b = clip(a), clip(b)
    levels = max(1, ((seen.last - seen.first) // bin_micros + 2).bit_length() + 1)
    starts = lambda df: df.select(F.col("i").alias("p"), F.col("lo").alias("t"))
    inside = _held(starts(b), a, seen.first, bin_micros, levels, most).select(F.col("i").alias(left_id), F.col("p").alias(right_id))
    # The second case leaves out equal starts, which the first has.
    later = _held(starts(a), b.withColumn("lo", F.col("lo") + 1).where("hi > lo"), seen.first, bin_micros, levels, most).select(F.col("p").alias(left_id), F.col("i").alias(right_id))
    return inside.unionByName(later)


def overlap_totals(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: tuple[str, str], right_at: tuple[str, str], bin_micros: int = DAY, most: int = CELL_POINTS) -> DataFrame:
    """(right_id, n, overlap_us, first): how many rows of ``left`` share a moment with each of ``right``, how long in all, and the smallest id of them.

    Rows of equal ends are joined as one: pairs are of different intervals,
    however many rows have them.  An overlap without an end adds nothing to the sum,
    which is a decimal: microseconds of millions of rows may be more than a long holds.
    """
    ends = lambda df, i, at: df.select(F.col(at[0]).alias("s"), F.col(at[1]).alias("e"), F.col(i).alias("i"))
    spans = ends(left, left_id, left_at).groupBy("s", "e").agg(F.count("*").alias("rows"), F.min("i").alias("first"))
    spans = spans.select("s", "e", F.struct("s", "e", "rows", "first").alias("x"))
    rows = ends(right, right_id, right_at)
    times = rows.select("s", "e").distinct().select("s", "e", F.struct("s", "e").alias("y"))
    pairs = overlap_join(spans, times, "x", "y", ("s", "e"), ("s", "e"), bin_micros, most)
    length = F.least(micros(F.col("x.e")), micros(F.col("y.e"))) - F.greatest(micros(F.col("x.s")), micros(F.col("y.s")))
    met = pairs.groupBy(F.col("y.s").alias("s"), F.col("y.e").alias("e")).agg(F.sum("x.rows").alias("n"), F.sum(length.cast("decimal(38,0)") * F.col("x.rows")).alias("us"), F.min("x.first").alias("first"))
    both = rows.join(met.withColumnsRenamed({"s": "ms", "e": "me"}), (F.col("s") == F.col("ms")) & F.col("e").eqNullSafe(F.col("me")))
    return both.groupBy(F.col("i").alias(right_id)).agg(F.sum("n").alias("n"), F.sum("us").cast("decimal(38,0)").alias("overlap_us"), F.min("first").alias("first"))
