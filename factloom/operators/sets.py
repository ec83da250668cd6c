"""Set operations on fact tables and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame, key: str = "fact_id") -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks."""
    return a.join(b.select(key), key, "left_anti")


def contained(a: DataFrame, b: DataFrame, key: str = "fact_id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union; columns that one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def differences(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows only in ``a`` and rows only in ``b``, as sets; nothing is coerced."""
    b = b.select(*a.columns)
    return a.distinct().exceptAll(b.distinct()), b.distinct().exceptAll(a.distinct())


def equivalent(a: DataFrame, b: DataFrame) -> bool:
    """Same columns, same types, same set of rows."""
    if sorted(a.columns) != sorted(b.columns) or dict(a.dtypes) != dict(b.dtypes):
        return False
    return _counted(a, b).where("n0 = 0 or n1 = 0").isEmpty()


def same_rows(a: DataFrame, *others: DataFrame) -> bool:
    """Whether each of ``others`` has the rows of ``a``, as many times each."""
    return _counted(a, *others).where(" or ".join(f"n0 <> n{k + 1}" for k in range(len(others)))).isEmpty()


def _counted(*sides: DataFrame) -> DataFrame:
    """How many times (n0, n1, ..) each side has a row: one grouping for all sides."""
    names = [f"c{k}" for k in range(len(sides[0].columns))]
    rows = None
    for k, side in enumerate(sides):
        one = side.select(*(F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(sides[0].columns, names))).withColumn("side", F.lit(k))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy(*names).agg(*(F.count(F.when(F.col("side") == k, 1)).alias(f"n{k}") for k in range(len(sides))))
