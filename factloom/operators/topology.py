"""Open sets as an inverted index: (open_set, kind, fact_id), derived from facts and never authoritative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts, temporal
from factloom.operators.closure import closed_members, closed_sizes

KINDS = ("event", "entity", "temporal", "context", "provenance", "neighborhood")


def _named(kinds: tuple[str, ...]) -> Column:
    """A fact's open sets of ``kinds`` (open_set, kind), as one array."""

    def sets(kind: str, names: Column) -> Column:
        return F.transform(names, lambda n: F.struct(F.concat(F.lit(kind + ":"), n).alias("open_set"), F.lit(kind).alias("kind")))

    refs = F.transform(F.filter("objects", lambda v: v["kind"] == "ref"), lambda v: v["ref"])
    by_kind = {
        "event": sets("event", F.array("fact_id")),
        "entity": sets("entity", F.array_distinct(F.concat(F.array("subject"), refs))),
        "temporal": sets("temporal", F.array(temporal.bucket(F.col("valid_start")))),
        "context": sets("context", contexts.ancestors(F.col("context"))),
        "provenance": F.concat(sets("source", F.array_compact(F.array("provenance.source"))), sets("method", F.array_compact(F.array("provenance.method")))),
        "neighborhood": sets("neighborhood", F.array_distinct(refs)),
    }
    unknown = set(kinds) - set(by_kind)
    if unknown:
        raise ValueError(f"unknown kinds of open sets: {sorted(unknown)}")
    return F.concat(*(by_kind[k] for k in kinds))


def points(facts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(fact_id, sets): each fact once, with the open sets (open_set, kind) of all its versions, of which it has a handful."""
    return facts.select("fact_id", _named(kinds).alias("sets")).groupBy("fact_id").agg(F.array_distinct(F.flatten(F.collect_list("sets"))).alias("sets"))


def members(facts: DataFrame, kinds: tuple[str, ...] = ("event", "entity", "temporal", "context", "provenance"), versions: bool = True) -> DataFrame:
    """Open sets of every fact by one explode: its event, its entities, its year, its context with all
    ancestors, its source and its method.  ``neighborhood`` adds the sets of facts that share a reference.
    With ``versions`` off every id has one row, and nothing has to be shuffled."""
    rows = facts.select("fact_id", F.explode(_named(kinds)).alias("o")).select("o.open_set", "o.kind", "fact_id")
    return rows.distinct() if versions else rows


def sizes(open_sets: DataFrame) -> DataFrame:
    return open_sets.groupBy("kind", "open_set").agg(F.count("*").alias("n_facts"))


def stalk(open_sets: DataFrame, facts: DataFrame, fact_id: str) -> DataFrame:
    """The sections of one fact: the fact in each of its open sets."""
    return open_sets.where(F.col("fact_id") == fact_id).join(facts, "fact_id")


def restrict(open_sets: DataFrame, facts: DataFrame, source: str, target: str) -> DataFrame:
    """Sections of ``source`` that also lie in ``target``."""
    u = open_sets.where(F.col("open_set") == source).select("fact_id")
    v = open_sets.where(F.col("open_set") == target).select("fact_id")
    return facts.join(u, "fact_id", "left_semi").join(v, "fact_id", "left_semi")


def minimal_open_set(open_sets: DataFrame, events: bool = True) -> DataFrame:
    """For each fact its smallest open set, by size and then by name.

    With ``events`` the sets include each fact's event, a set of that fact
    alone: then the smallest is one of the sets of one fact, and one grouping
    by set and one by fact find it.
    """
    if events:
        one = open_sets.groupBy("open_set").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("fact_id")).where("n_facts = 1")
        return one.groupBy("fact_id").agg(F.min("open_set").alias("open_set")).select("fact_id", "open_set", F.lit(1).cast("long").alias("n_facts"))
    size = sizes(open_sets).select("open_set", "n_facts")
    return open_sets.join(size, "open_set").groupBy("fact_id").agg(F.min(F.struct("n_facts", "open_set")).alias("m")).select("fact_id", F.col("m.open_set").alias("open_set"), F.col("m.n_facts").alias("n_facts"))


def restriction_edges(open_sets: DataFrame) -> DataFrame:
    """(source, target): target is a proper part of source, found by counting shared facts against the smaller size."""
    size = sizes(open_sets).select("open_set", "n_facts")
    a = open_sets.select(F.col("open_set").alias("source"), "fact_id")
    b = open_sets.select(F.col("open_set").alias("target"), "fact_id")
    shared = a.join(b, "fact_id").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("shared"))
    sized = shared.join(size.select(F.col("open_set").alias("target"), F.col("n_facts").alias("n_target")), "target")
    return sized.where("shared = n_target").select("source", "target")


def union(open_sets: DataFrame, u: str, v: str) -> DataFrame:
    """Points of either set."""
    return open_sets.where(F.col("open_set").isin(u, v)).select("fact_id").distinct()


def intersection(open_sets: DataFrame, u: str, v: str) -> DataFrame:
    """Points of both sets, by one grouping."""
    both = open_sets.where(F.col("open_set").isin(u, v)).groupBy("fact_id").agg(F.count_distinct("open_set").alias("n"))
    return both.where(F.col("n") == (1 if u == v else 2)).select("fact_id")


def is_subset(open_sets: DataFrame, u: str, v: str) -> bool:
    """Whether all points of ``u`` lie in ``v``."""
    own = open_sets.where(F.col("open_set") == u).select("fact_id")
    return own.join(open_sets.where(F.col("open_set") == v).select("fact_id"), "fact_id", "left_anti").isEmpty()


def united_sections(sections: list[DataFrame]) -> DataFrame:
    """Sections of several sets, each fact's last version once."""
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out.groupBy("fact_id").agg(F.max_by(F.struct(*out.columns), "seq").alias("f")).select("f.*")


def full(facts: DataFrame, kinds: tuple[str, ...] = ("entity", "context")) -> DataFrame:
    """(open_set, fact_id) of the full topology: the sets of ``kinds`` closed under intersection."""
    return closed_members(members(facts, kinds))


def full_sizes(facts: DataFrame, kinds: tuple[str, ...] = ("entity", "context")) -> DataFrame:
    """(n_facts, n_sets): how many sets of the full topology have as many points."""
    return closed_sizes(points(facts, kinds).select(F.array_distinct(F.transform("sets", lambda o: o["open_set"])).alias("sets")))


def intersection_closure(open_sets: DataFrame) -> DataFrame:
    """``closed_members`` as (points, open_set)."""
    return closed_members(open_sets).groupBy("open_set").agg(F.array_sort(F.collect_list("fact_id")).alias("points")).select("points", "open_set")


def axiom_report(facts: DataFrame, open_sets: DataFrame) -> DataFrame:
    """(axiom, violations): locality and gluing fail where versions of one fact differ in content; restricting a set
    to itself has to give it back (identity), and restricting along nested contexts one by one what restricting at
    once gives (composition); no open set may be empty of known facts."""
    content = F.sha2(F.to_json(F.struct("subject", "relation", "objects", "attributes")), 256)
    clash = facts.groupBy("fact_id").agg(F.countDistinct(content).alias("n")).where("n > 1")
    lost = open_sets.join(facts.select("fact_id"), "fact_id", "left_anti")
    point = ["open_set", "fact_id"]
    same = open_sets.join(open_sets.select(*point), point, "left_semi").select(*point)
    identity = open_sets.select(*point).exceptAll(same)
    nested = open_sets.where("kind = 'context'").select(F.col("open_set").alias("low"), "fact_id")
    above = lambda c: F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", ""))
    nested = nested.withColumn("mid", above(F.col("low"))).withColumn("top", above(F.col("mid"))).where("top is not null")
    held = lambda name: open_sets.select(F.col("open_set").alias(name), "fact_id")
    at_once = nested.join(held("top"), ["top", "fact_id"], "left_semi")
    composition = at_once.join(held("mid"), ["mid", "fact_id"], "left_anti")
    parts = [("locality", clash), ("gluing", clash), ("identity", identity), ("composition", composition), ("known points", lost)]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("axiom"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
