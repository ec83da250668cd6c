"""All intersections of open sets, as closed item sets.

A point is a transaction of the sets that hold it; the intersections of sets
are the extents of closed item sets.  Points in the same sets are one row with
a weight.  Items are ordered from the rarest; every closed set is reached once,
by the path of items that canonical generation adds, so what starts with a
prefix can be enumerated by itself.  Prefixes of few rows are enumerated in one
go, a partition's one after the other; those of many are closed by counting,
and their continuations are prefixes of the next round.  Nothing is refused and
nothing is left out: the work and the result are as large as the closure.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.staging import cut

#: Rows of a prefix that one task enumerates; a prefix of more is closed by counting.
ROWS = 20_000
#: Digits of the count that orders items: an item is its count, a bar and its name.
DIGITS = 15
#: Rows of a record batch of the result.
BATCH = 50_000
_STEP = "\x1f"


def _name(n: int, closed: list[str], path: list[str]) -> str:
    """Of sets that have exactly these points the smallest name; else the names of the path."""
    same = [i[DIGITS + 1 :] for i in closed if int(i[:DIGITS]) == n]
    return min(same) if same else "&".join(sorted(i[DIGITS + 1 :] for i in path))


def extents(path: list, intent: list, j, rows: list[list]) -> Iterator[tuple[list[int], list, list]]:
    """(indices of rows, closed items, path) of every closed set that is reached through ``path`` and then ``j``; ``rows`` are the items of all that have these."""
    masks: dict = {}
    for k, items in enumerate(rows):
        for i in items:
            masks[i] = masks.get(i, 0) | 1 << k
    held = [((1 << len(rows)) - 1, frozenset(intent), j, [*path, j], sorted(masks))]
    while held:
        extent, before, last, way, items = held.pop()
        items = [i for i in items if masks[i] & extent]
        closed = [i for i in items if masks[i] & extent == extent]
        if any(i < last and i not in before for i in closed):
            continue  # reached through a rarer item
        yield [k for k in range(len(rows)) if extent >> k & 1], closed, way
        known = frozenset(closed)
        held += [(extent & masks[i], known, i, [*way, i], items) for i in items if i > last and i not in known]


def enumerate_prefix(path: list[str], intent: list[str], j: str, rows: list[tuple[str, int, list[str]]]) -> Iterator[tuple[str, list[str]]]:
    """(name, transactions) of every closed set of ``extents``."""
    for here, closed, way in extents(path, intent, j, [items for _, _, items in rows]):
        yield _name(sum(rows[k][1] for k in here), closed, way), [rows[k][0] for k in here]


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix in; (open_set, tx) out."""
    names: list[str] = []
    txs: list[str] = []

    def made() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(txs, pa.string())], names=["open_set", "tx"])
        names.clear()
        txs.clear()
        return out

    def done() -> Iterator[pa.RecordBatch]:
        for name, extent in enumerate_prefix(path, intent, j, rows):
            for lo in range(0, len(extent), BATCH):
                part = extent[lo : lo + BATCH]
                names.extend([name] * len(part))
                txs.extend(part)
                if len(names) >= BATCH:
                    yield made()

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["prefix"] != now:
                if rows:
                    yield from done()
                now, rows, path, intent, j = r["prefix"], [], r["path"], r["intent"], r["j"]
            rows.append((r["tx"], r["w"], r["items"]))
    if rows:
        yield from done()
    if names:
        yield made()


def closed_members(open_sets: DataFrame, rows: int = ROWS) -> DataFrame:
    """(open_set, fact_id) of all non-empty intersections of (open_set, fact_id): sets with equal points are one.

    A set that is an original one goes by the smallest of its names, any other
    by the names of the sets of its canonical path; a set of one point by the
    shortest name that it has.
    """
    points = cut(open_sets.select("open_set", "fact_id").distinct(), "closure")
    size = points.groupBy("open_set").agg(F.count("*").alias("n"))
    sized = points.join(size, "open_set")
    alone = sized.where("n = 1").select("open_set", "fact_id")
    item = F.concat(F.lpad(F.col("n").cast("string"), DIGITS, "0"), F.lit("|"), F.col("open_set"))
    # A point's sets, of which it has a handful, are one array.
    facts = sized.where("n > 1").groupBy("fact_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    facts = cut(facts.withColumn("tx", F.sha2(F.array_join("items", _STEP), 256)), "closure")
    tx = facts.groupBy("tx").agg(F.first("items").alias("items"), F.count("*").alias("w"))

    n = facts.count()
    found = []
    everywhere = [r.item for r in size.where(F.col("n") == n).select(item.alias("item")).orderBy("item").collect()]  # sets of all points: a point's at most
    if everywhere:
        found.append(facts.select(F.lit(_name(n, everywhere, [])).alias("open_set"), "tx").distinct())
    whole = F.array(*map(F.lit, everywhere)).cast("array<string>")
    open_ = tx.select(F.array().cast("array<string>").alias("path"), whole.alias("intent"), F.explode(F.array_except("items", whole)).alias("j"), "tx", "w", "items")
    while True:
        open_ = cut(open_.withColumn("prefix", F.concat_ws(_STEP, "path", "j")), "closure")
        many = cut(open_.groupBy("prefix").agg(F.count("*").alias("rows"), F.sum("w").alias("n")).where(F.col("rows") > rows), "closure")
        light = open_.join(many, "prefix", "left_anti")
        found.append(cut(light.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_enumerate, "open_set string, tx string"), "closure"))
        if many.isEmpty():
            break
        heavy = open_.join(many.select("prefix", "n"), "prefix")
        held = heavy.select("prefix", "n", "w", F.explode("items").alias("item")).groupBy("prefix", "n", "item").agg(F.sum("w").alias("with")).where(F.col("with") == F.col("n"))
        closed = held.groupBy("prefix").agg(F.sort_array(F.collect_list("item")).alias("closed"))  # a row's items at most
        heavy = heavy.join(closed, "prefix")
        heavy = cut(heavy.where(F.size(F.filter(F.array_except("closed", "intent"), lambda i: i < F.col("j"))) == 0), "closure")
        way = F.concat("path", F.array("j"))
        bare = lambda i: F.substring(i, DIGITS + 2, 1 << 30)
        same = F.array_min(F.transform(F.filter("closed", lambda i: F.substring(i, 1, DIGITS).cast("long") == F.col("n")), bare))
        found.append(heavy.select(F.coalesce(same, F.array_join(F.array_sort(F.transform(way, bare)), "&")).alias("open_set"), "tx"))
        after = F.explode(F.filter(F.array_except("items", "closed"), lambda i: i > F.col("j")))
        open_ = heavy.withColumn("next", after).select(way.alias("path"), F.col("closed").alias("intent"), F.col("next").alias("j"), "tx", "w", "items")
    sets = found[0]
    for more in found[1:]:
        sets = sets.unionByName(more)
    members = cut(sets.join(facts.select("tx", "fact_id"), "tx").select("open_set", "fact_id"), "closure")
    counts = members.groupBy("open_set").agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id"))
    short = F.struct(F.length("open_set"), "open_set")
    one = counts.where("n = 1").select("open_set", "fact_id").unionByName(alone).groupBy("fact_id").agg(F.min_by("open_set", short).alias("open_set"))
    wide = members.join(counts.where("n = 1").select("open_set"), "open_set", "left_anti")
    return wide.select("open_set", "fact_id").unionByName(one.select("open_set", "fact_id"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix in; (n, alone, sets) out: how many closed sets have n points, those of one point apart by whether its row is ``alone``."""
    counts: Counter = Counter()

    def done() -> None:
        for here, _, _ in extents(path, intent, j, [r["items"] for r in rows]):
            n = sum(rows[k]["w"] for k in here)
            counts[n, n == 1 and rows[here[0]]["alone"]] += 1

    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if (r["path"], r["j"]) != now:
                if rows:
                    done()
                now, rows, path, intent, j = (r["path"], r["j"]), [], r["path"], r["intent"], r["j"]
            rows.append(r)
    if rows:
        done()
    made = [(n, alone, k) for (n, alone), k in counts.items()]
    kinds = (pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], names=["n", "alone", "sets"])


def closed_sizes(points: DataFrame, rows: int = ROWS) -> DataFrame:
    """(n_facts, n_sets) of ``closed_members``, with no set's points written; ``points`` are facts once each with their ``sets``, an array of names.

    Sets of at most ``rows`` points are prefixes by themselves, of as many
    rows.  A closed set in which no such set is can be reached by the others
    alone, in which facts are few different rows with a weight; these carry
    those small sets that hold all their facts, so that what is reached by a
    small set too is left to it.
    """
    own = cut(points.select(F.monotonically_increasing_id().alias("rid"), "sets"), "closure")
    size = own.select(F.explode("sets").alias("open_set")).groupBy("open_set").agg(F.count("*").alias("n")).where("n > 1")
    item = cut(size.repartitionByRange("n", "open_set").sortWithinPartitions("n", "open_set").select("open_set", "n", F.monotonically_increasing_id().alias("item")), "closure")
    total = own.count()
    wide = item.where(F.col("n") > rows)  # a fact's sets over ``rows`` for each fact at most
    first = wide.agg(F.min("item")).first()[0]
    first = 1 << 62 if first is None else first
    whole = [r.item for r in item.where(F.col("n") == total).select("item").orderBy("item").collect()]  # sets of all facts: a fact's at most
    each = own.select("rid", F.size("sets").alias("k"), F.explode("sets").alias("open_set"))
    few = each.join(F.broadcast(wide.select("open_set")), "open_set", "left_anti").join(item.where(F.col("n") <= rows), "open_set")
    both = each.join(F.broadcast(wide), "open_set").select("rid", "k", "item").unionByName(few.select("rid", "k", "item"))
    facts = both.groupBy("rid").agg(F.sort_array(F.collect_list("item")).alias("items"), F.first("k").alias("k"))  # a fact's sets, of which it has a handful
    facts = cut(facts.select("items", (F.size("items") < F.col("k")).alias("alone"), F.filter("items", lambda i: i >= first).alias("large"), F.filter("items", lambda i: i < first).alias("small")), "closure")
    none = F.array().cast("array<bigint>")
    known = F.array(*map(F.lit, whole)).cast("array<bigint>")
    shape = "n long, alone boolean, sets long"
    start = lambda df, j: df.select(none.alias("path"), known.alias("intent"), F.explode(F.array_except(j, known)).alias("j"), "w", "alone", "items")
    counted = lambda df: cut(df.repartition("path", "j").sortWithinPartitions("path", "j").mapInArrow(_count, shape), "closure")
    found = [counted(start(facts.withColumn("w", F.lit(1).cast("long")), "small"))]

    rest = cut(facts.groupBy("large").agg(F.count("*").alias("w"), F.max("alone").alias("alone")), "closure")
    inside = facts.join(rest.where(F.col("w") <= rows).select("large", "w"), "large").select("large", "w", F.explode("small").alias("item"))
    inside = inside.groupBy("large", "w", "item").agg(F.count("*").alias("with")).where(F.col("with") == F.col("w")).groupBy("large").agg(F.collect_list("item").alias("small"))
    rest = rest.join(inside, "large", "left").withColumn("items", F.sort_array(F.concat(F.coalesce("small", none), "large")))
    open_ = start(rest, "large")
    while True:
        open_ = cut(open_, "closure")
        many = cut(open_.groupBy("path", "j").agg(F.count("*").alias("rows"), F.sum("w").alias("n")).where(F.col("rows") > rows).select("path", "j", "n"), "closure")
        found.append(counted(open_.join(many, ["path", "j"], "left_anti").select("path", "intent", "j", "w", "alone", "items")))
        if many.isEmpty():
            break
        heavy = open_.join(many, ["path", "j"])
        held = heavy.select("path", "j", "n", "w", F.explode("items").alias("item")).groupBy("path", "j", "n", "item").agg(F.sum("w").alias("with")).where(F.col("with") == F.col("n"))
        closed = held.groupBy("path", "j").agg(F.sort_array(F.collect_list("item")).alias("closed"))  # a row's items at most
        heavy = cut(heavy.join(closed, ["path", "j"]).where(F.size(F.filter(F.array_except("closed", "intent"), lambda i: i < F.col("j"))) == 0), "closure")
        found.append(heavy.select("path", "j", "n").distinct().select("n", F.lit(False).alias("alone"), F.lit(1).cast("long").alias("sets")))
        after = F.explode(F.filter(F.array_except("items", "closed"), lambda i: i > F.col("j")))
        open_ = heavy.withColumn("next", after).select(F.concat("path", F.array("j")).alias("path"), F.col("closed").alias("intent"), F.col("next").alias("j"), "w", "alone", "items")
    sets = found[0]
    for more in found[1:]:
        sets = sets.unionByName(more)
    if whole:
        sets = sets.unionByName(own.limit(1).select(F.lit(total).cast("long").alias("n"), F.lit(False).alias("alone"), F.lit(1).cast("long").alias("sets")))
    # Sets of one point that are sets by themselves are one for each fact that has any.
    single = own.count() - facts.where("not alone").count()
    sets = sets.where("not alone").select("n", "sets").unionByName(own.limit(1).select(F.lit(1).cast("long").alias("n"), F.lit(single).cast("long").alias("sets")))
    return sets.groupBy(F.col("n").alias("n_facts")).agg(F.sum("sets").alias("n_sets")).where("n_sets > 0")
