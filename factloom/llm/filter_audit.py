"""How filters interact: what each removes in every order of application.

The filters' failures are one mask of five bits a document, made by native
expressions.  Whether a text is a copy is a grouping of digests and a join on
the id (a digest's smallest id is one row, so no group of copies meets in a
task).  Documents are then counted in 32 cells a part; every order, step and
share follows from the sums of cells, so no document is looked at twice.

Defined results: a null text is empty, a null lang the empty part; every row is
a document, repeated ones too; a null id is never larger than another, so such
a row fails no E, and has no labels; several labels of one id count as their
largest; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.work import Workspace

FILTERS = "ABCDE"
MIN_WORDS = 200
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL = (1 << len(FILTERS)) - 1


def failures(text: Column, words: Column) -> Column:
    """Bits of A to D that a text of these words fails."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length, upper = F.length(text).cast("long"), (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long")
    fails = [n < MIN_WORDS, 100 * distinct < 50 * n, 100 * upper > 3 * length, text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, part, mask) of every row; bit k stands for the failure of filter k."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WORD_GAP), ""))
    # A digest of 256 bits stands for its text: no two texts are known that share one.
    rows = ws.table(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text"), F.col("words")).alias("mask")), "masks")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = rows.where("doc_id is not null").join(first, ["doc_id", "digest"], "left")
    known = known.select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"))
    return known.unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones of every (part, mask) that occurs."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    known = masked.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "mask", F.lit(1).alias("n"), "good", "toxic")
    rest = masked.where("doc_id is null").select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return known.unionByName(rest).groupBy("part", "mask").agg(total("n"), total("good"), total("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """All orders and steps of every part, from its cells.

    ``clear[s]`` is the number of documents that fail none of the filters in
    the set s; a step that adds a filter to s removes clear[s] - clear[s + it].
    """
    free = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in range(_ALL + 1)])
    parts = counted.groupBy("part").agg(*[free(c).alias(c) for c in ("n", "good", "toxic")])
    # How many orders apply filter f just after the filters of s: |s|! ways before it, the others' after it.
    ways = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
    shares = [sum((F.lit(ways(s)) * (F.col("n")[s] - F.col("n")[s | 1 << f]) for s in range(_ALL + 1) if not s >> f & 1), F.lit(0)) for f in range(len(FILTERS))]
    parts = parts.withColumn("shares", F.array(*shares))
    made = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = parts.withColumn("filter_order", F.explode(made)).withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(len(FILTERS))])))
    earlier = F.substring("filter_order", 1, F.col("step") - 1)
    before = sum((F.when(F.contains(earlier, F.lit(x)), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("f", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), 1)) - 1).withColumn("before", before)
    bit = F.element_at(F.array(*[F.lit(1 << f) for f in range(len(FILTERS))]), F.col("f") + 1)
    at = lambda c, s: F.element_at(c, s + 1)
    after = F.col("before").bitwiseOR(bit)
    removed = at("n", F.col("before")) - at("n", after)
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n", after).alias("kept"),
        removed.alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - removed).alias("redundant"),
        (at("n", F.lit(_ALL) - bit) - at("n", F.lit(_ALL))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", after)).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", after)).alias("toxic_lost"),
        at("shares", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    ws = Workspace(docs.sparkSession, "filter-audit")
    counted = ws.table(cells(masks(docs, ws), labels), "cells")
    ws.drop("masks")
    return orders(counted)
