"""Descriptive statistics and storage figures."""

from __future__ import annotations

import math

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.staging import cut


def describe(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, population variance and deviation, exact percentiles by rank, extremes and a normal 95 % interval.

    Percentile p is the element at index int(n * p / 100), from 0, of the
    sorted values.  Ranks come from counts of distinct values, so a group is
    never gathered in one place.
    """
    x = F.col(column)
    base = df.where(x.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("variance"),
        F.stddev_pop(x).alias("stddev"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
    )
    middle = _at_ranks(df, column, {"lower": lambda n: F.floor((n - 1) / 2), "upper": lambda n: F.floor(n / 2)}, by)
    middle = middle.select(*by, ((F.col("lower") + F.col("upper")) / 2).alias("median"))
    if by:
        same = [base[c].eqNullSafe(middle[c]) for c in by]
        base = base.join(middle, same).select(*(base[c] for c in base.columns), "median")
    else:
        base = base.where("n > 0").join(F.broadcast(middle))  # one row each
    half = F.lit(1.96) * F.col("stddev") / F.sqrt("n")
    return base.withColumn("ci_low", F.col("mean") - half).withColumn("ci_high", F.col("mean") + half)


def ranked(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99), by: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles by rank: percentile p is the element at index int(n * p / 100)."""
    return _at_ranks(df, column, {f"p{p}": lambda n, p=p: F.least(n - 1, F.floor(n * F.lit(p) / 100)) for p in percents}, by)


def _at_ranks(df: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], by: tuple[str, ...]) -> DataFrame:
    """The values at indices of the sorted values, each given by the number of values, from running counts over distinct ones.

    The values are dealt by ranges and counted within each range; only the
    ranges' totals are summed in one place, so neither one group nor the whole
    table is ever sorted by a single task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("c"))
    dealt = cut(counts.repartitionByRange(*by, column).withColumn("part", F.spark_partition_id()), "ranked")
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    totals = dealt.groupBy(*by, "part").agg(F.sum("c").alias("t"))
    totals = totals.select(*by, "part", (F.sum("t").over(over.orderBy("part")) - F.col("t")).alias("before"), F.sum("t").over(over).alias("n"))
    run = dealt.withColumn("upto", F.sum("c").over(W.partitionBy(*by, "part").orderBy(column)))
    run = run.join(totals, [run[c].eqNullSafe(totals[c]) for c in [*by, "part"]]).select(*(run[c] for c in run.columns), "before", "n").withColumn("upto", F.col("upto") + F.col("before"))
    return run.groupBy(*by).agg(*(F.min(F.when(F.col("upto") > index(F.col("n")), F.col(column))).alias(name) for name, index in ranks.items()))


#: Multiplier of the mixing of keys and rounds: below 2^31, so that products of 32-bit numbers fit 63 bits.
MIXER = 1_103_515_245


def poisson_steps(most: int = 12) -> list[float]:
    """Chances that a Poisson number of mean 1 is at most 0, 1, .."""
    out, term = [], math.exp(-1)
    for k in range(most):
        out.append(term + (out[-1] if out else 0.0))
        term /= k + 1
    return out


def bootstrap(df: DataFrame, column: str, key: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of resampled means, by Poisson weights: each row draws its own count per round.

    A row's counts follow from its whole-number ``key``, the round and the seed
    alone, so the interval is the same however rows are dealt.  A task hands on
    one sum a round, so rows are not multiplied.
    """
    steps = poisson_steps()

    def draw(batches):
        import numpy as np
        import pandas as pd

        weight, total, cut = np.zeros(rounds, np.int64), np.zeros(rounds), np.array(steps)
        turn = np.arange(rounds, dtype=np.int64) * 214_013 + seed
        for b in batches:
            x, k = b["x"].to_numpy(), b["k"].to_numpy()
            for lo in range(0, len(x), 1000):
                h = (k[lo : lo + 1000] * MIXER + turn[:, None]) % (1 << 32)
                for shift in (16, 13):
                    h = (h ^ h >> shift) * MIXER % (1 << 32)
                n = np.searchsorted(cut, (h ^ h >> 16) / (1 << 32), "right")
                weight += n.sum(axis=1)
                total += n @ x[lo : lo + 1000]
        yield pd.DataFrame({"round": np.arange(rounds), "k": weight, "kx": total})

    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.pmod(F.col(key).cast("long"), F.lit(1 << 31)).alias("k"))
    sums = rows.mapInPandas(draw, "round long, k long, kx double")
    means = sums.groupBy("round").agg(F.try_divide(F.sum("kx"), F.sum("k")).alias("m"))
    return means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, infinite where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float("inf")))


def selectivity(df: DataFrame, column: str) -> DataFrame:
    """min(1, 1 / distinct values), 0.5 for an empty table."""
    return df.agg(F.count_distinct(column).alias("d")).select(F.when(F.col("d") > 0, F.least(F.lit(1.0), 1 / F.col("d"))).otherwise(F.lit(0.5)).alias("selectivity"))


def storage(df: DataFrame) -> DataFrame:
    """Rows, bytes of their JSON form, and bytes a row."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(size), F.lit(0)).alias("json_bytes")).withColumn("bytes_per_row", F.coalesce(F.try_divide(F.col("json_bytes"), F.col("n_rows")), F.lit(0.0)))


def predicate_frequency(triples: DataFrame, column: str = "predicate") -> DataFrame:
    return triples.groupBy(column).agg(F.count("*").alias("n"))
