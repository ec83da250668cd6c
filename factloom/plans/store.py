"""FactStore: partitioned Parquet facts, merged on read, with commits that never lose each other.

A write puts its rows into a folder of its own and then takes the next number
of the log, by a file that can be created once.  An update's rows come with
marks: a version is current if no mark of its fact is later than it.  So reads
are one scan without what the marks name, and a scan alone where there are none.

``compact`` takes a number like any writer and says up to which commit its
snapshot goes; later ones stay beside it.  A writer that finds a snapshot taken
since it began writes again, with a later version number; a snapshot brings the
marks it has merged, so that what was written beside it is older where it has
to be.
"""

from __future__ import annotations

import json
import secrets
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.staging import cut
from factloom.operators import access, estimates, gluing, topology, triples, validate
from factloom.plans import language, partitions, planner, sparql
from factloom.sources import msgpack

MARK = "fact_id string, seq long"
#: Columns of which row groups carry Bloom filters: a fact or a subject is looked up without reading the others.
BLOOM = ("fact_id", "subject")


def _stamp() -> int:
    """A number later than those of earlier commits that no other writer has: microseconds, and 11 bits by chance."""
    return time.time_ns() // 1000 << 11 | secrets.randbits(11)


@dataclass(frozen=True)
class State:
    """What the log says up to commit ``last``: the snapshot, the commits beside it, and the last snapshot's own number."""

    last: int
    base: str
    base_number: int
    through: int
    added: tuple[str, ...]
    marked: tuple[str, ...]
    seq: int

    @property
    def commits(self) -> tuple[str, ...]:
        return (self.base, *self.added)


class FactStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # lifecycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, facts: DataFrame | None = None) -> FactStore:
        """A new store; a path that holds one already raises."""
        store = cls(spark, path)
        if store._numbers():
            raise ValueError(f"{path} holds a store already")
        commit = uuid.uuid4().hex
        rows = spark.createDataFrame([], V.FACT) if facts is None else facts
        # Of several versions of a fact the last one counts.
        marked = store._mark(store._write(rows, commit), commit)
        most = store._read("facts", [commit], f"{MARK}, commit string, {partitions.SCHEMA}").agg(F.max("seq")).first()[0]
        if not store._claim(0, {"base": commit, "through": 0, "marked": marked, "seq": most or 0}):
            store._forget(commit)
            raise ValueError(f"{path} holds a store already")
        return store

    def drop(self) -> None:
        p = self._hadoop(self.path)
        self._fs(p).delete(p, True)

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, p):
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, folder: str) -> list[str]:
        p = self._hadoop(f"{self.path}/{folder}")
        fs = self._fs(p)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    # the log

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._children("log") if n.isdigit())

    def _record(self, number: int) -> dict:
        p = self._hadoop(f"{self.path}/log/{number:019d}")
        jvm = self.spark.sparkContext._jvm
        for _ in range(100):  # a number is taken a moment before its text is there
            stream = self._fs(p).open(p)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            time.sleep(0.05)
        raise OSError(f"commit {number} of {self.path} is not whole")

    def _claim(self, number: int, record: dict) -> bool:
        """Take ``number``; False if another commit has it."""
        p = self._hadoop(f"{self.path}/log/{number:019d}")
        jvm = self.spark.sparkContext._jvm
        try:
            stream = self._fs(p).create(p, False)
        except Exception as taken:  # noqa: BLE001  what a file system says of a file that is there
            if self._fs(p).exists(p):
                return False
            raise taken
        try:
            stream.write(bytearray((json.dumps(record) + "\n").encode()))
        finally:
            stream.close()
        return True

    def state(self) -> State:
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"{self.path} holds no store")
        later: list[dict] = []
        base = None
        for n in reversed(numbers):
            if base is not None and n <= base[1]["through"]:
                break
            record = self._record(n)
            if "base" in record:
                if base is None:
                    base = (n, record)
            else:
                later.append(record)
        number, record = base
        later.reverse()
        marked = [record["base"]] * record["marked"] + [r["add"] for r in later if r["marked"]]
        added = tuple(r["add"] for r in later if r["rows"])
        return State(numbers[-1], record["base"], number, record["through"], added, tuple(marked), record["seq"])

    def _commit(self, make: Callable[[State, str, int], dict | None]) -> None:
        """``make`` writes under a new name and gives the record; again, if a snapshot has been taken meanwhile."""
        while True:
            state, commit = self.state(), uuid.uuid4().hex
            record = make(state, commit, max(_stamp(), state.seq + 1))
            if record is None:
                return
            number = state.last + 1
            while not (done := self._claim(number, record)):
                if "base" in self._record(number):
                    break
                number += 1
            if done:
                return
            self._forget(commit)

    def _forget(self, commit: str) -> bool:
        gone = False
        for table in ("facts", "gone", "sketches"):
            p = self._hadoop(f"{self.path}/{table}/commit={commit}")
            gone |= self._fs(p).delete(p, True)
        return gone

    # tables

    def _write(self, facts: DataFrame, commit: str) -> DataFrame:
        """One row a fact and version, by partition and subject; returns the ids of several versions (fact_id, seq of the last).

        Rebalancing, which splits a partition that holds most rows, is the only shuffle of whole facts: rows that
        repeat a version are rare, and ids say whether there are any.
        """
        into = f"{self.path}/facts/commit={commit}"
        self._lay(facts, into)
        several = self._several(commit)
        if not several.isEmpty() and self._once(several, into):
            several = self._several(commit)
        schema = f"fact_id string, subject string, relation string, context string, confidence double, objects array<{V.VALUE.simpleString()}>, commit string, {partitions.SCHEMA}"
        estimates.sketches(self._read("facts", [commit], schema)).write.parquet(f"{self.path}/sketches/commit={commit}")
        return several

    def _lay(self, facts: DataFrame, into: str) -> None:
        rows = partitions.with_columns(facts.select(*V.FACT.fieldNames())).hint("rebalance", *partitions.COLUMNS).sortWithinPartitions(*partitions.COLUMNS, "subject")
        out = rows.write.partitionBy(*partitions.COLUMNS)
        for c in BLOOM:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
        out.parquet(into)

    def _several(self, commit: str) -> DataFrame:
        known = self._read("facts", [commit], f"{MARK}, commit string, {partitions.SCHEMA}")
        return cut(known.groupBy("fact_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n")).where("n > 1").select("fact_id", "seq"), "several")

    def _once(self, several: DataFrame, into: str) -> bool:
        """Lay ``into`` again with one row a version, where a version has more; whether it had."""
        rows, ids = self.spark.read.schema(V.FACT).parquet(into).select(*V.FACT.fieldNames()), several.select(F.col("fact_id").alias("id"))
        same, whole = F.col("fact_id").eqNullSafe(F.col("id")), F.struct(*V.FACT.fieldNames())
        among = cut(rows.join(ids, same, "left_semi"), "several")
        one = cut(among.groupBy("fact_id", "seq").agg(F.max_by(whole, F.xxhash64(F.to_json(whole))).alias("f")).select("f.*"), "several")
        if one.count() == among.count():
            return False
        again = cut(rows.join(ids, same, "left_anti").unionByName(one), "several")
        p = self._hadoop(into)
        self._fs(p).delete(p, True)
        self._lay(again, into)
        return True

    def _mark(self, marks: DataFrame, commit: str) -> bool:
        path = f"{self.path}/gone/commit={commit}"
        marks.select("fact_id", F.col("seq").cast("long")).write.parquet(path)
        return not self.spark.read.schema(MARK).parquet(path).isEmpty()

    def _read(self, table: str, commits: Iterable[str], schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/commit={c}" for c in commits]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def _facts(self, state: State) -> DataFrame:
        named = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in V.FACT.fields)
        return self._read("facts", state.commits, f"{named}, commit string, {partitions.SCHEMA}")

    def _marks(self, state: State) -> DataFrame:
        return self._read("gone", state.marked, f"{MARK}, commit string").groupBy("fact_id").agg(F.max("seq").alias("gone"))

    # reads

    def versions(self) -> DataFrame:
        return self._facts(self.state()).select(*V.FACT.fieldNames())

    def _live(self, state: State, keep: Column | None = None) -> DataFrame:
        rows = self._facts(state)
        if keep is not None:
            rows = rows.where(keep)
        if state.marked:
            gone = self._marks(state).withColumnRenamed("fact_id", "marked")
            rows = rows.join(gone, (F.col("fact_id") == F.col("marked")) & (F.col("seq") < F.col("gone")), "left_anti")
        return rows.select(*V.FACT.fieldNames())

    def facts(self) -> DataFrame:
        """The last version of each fact that no later mark removes."""
        return self._live(self.state())

    def query(self, q: access.Query) -> DataFrame:
        """The rows of ``access.run``, out of the partitions that can hold them."""
        return access.run(self._live(self.state(), partitions.pruning(q)), q)

    def sparql(self, text: str) -> DataFrame:
        return sparql.run(triples.statements(self.facts()), text)

    def select(self, text: str) -> DataFrame:
        """The SQL-like language; the table is ``facts``."""
        return language.run(text, {"facts": self.facts()})

    def explain(self, q: access.Query) -> str:
        choice = planner.choose(q, self._sizes())
        return f"{choice}\n{planner.explain(self.query(q))}"

    def _sizes(self) -> planner.Statistics:
        n = self.facts().count()
        return planner.Statistics(n, 12 * n)

    # writes

    def _next_seq(self) -> int:
        return max(_stamp(), self.state().seq + 1)

    def insert(self, facts: DataFrame) -> None:
        """Append; a fact whose id is there already becomes its newer version."""

        def make(state: State, commit: str, seq: int) -> dict:
            rows = facts.withColumn("seq", F.lit(seq).cast("long")).select(*(F.col(f.name).cast(f.dataType) for f in V.FACT.fields))
            self._write(rows, commit)
            ids = self._read("facts", [commit], f"fact_id string, commit string, {partitions.SCHEMA}")
            marked = self._mark(ids.select("fact_id").withColumn("seq", F.lit(seq)), commit)  # of one version, so once each
            return {"add": commit, "rows": True, "marked": marked}

        self._commit(make)

    def update(self, facts: DataFrame) -> int:
        """Newer versions of facts that exist; returns how many ids there were."""
        known = cut(facts.join(self.facts().select("fact_id"), "fact_id", "left_semi"), "known")
        n = known.select("fact_id").distinct().count()
        if n:
            self.insert(known)
        return n

    def delete(self, ids: Iterable[str] | DataFrame) -> int:
        """Remove facts by id; returns how many existed."""
        rows = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "fact_id string")
        found = 0

        def make(state: State, commit: str, seq: int) -> dict | None:
            nonlocal found
            there = self._live(state).select("fact_id").join(rows, "fact_id", "left_semi")
            marked = self._mark(there.withColumn("seq", F.lit(seq)), commit)
            found = self._read("gone", [commit], f"{MARK}, commit string").count()
            if not marked:
                self._forget(commit)
                return None
            return {"add": commit, "rows": False, "marked": True}

        self._commit(make)
        return found

    def _snapshot(self, rows: Callable[[State], DataFrame]) -> None:
        """Commit ``rows`` as the facts up to now; where another snapshot comes first, that one has done it."""
        state, commit = self.state(), uuid.uuid4().hex
        self._write(rows(state), commit)
        most = self._read("facts", [commit], f"{MARK}, commit string, {partitions.SCHEMA}").agg(F.max("seq")).first()[0]
        recent = [c for c in state.marked if c != state.base]
        marked = bool(recent) and self._mark(self._read("gone", recent, f"{MARK}, commit string").groupBy("fact_id").agg(F.max("seq").alias("seq")), commit)
        record = {"base": commit, "through": state.last, "marked": marked, "seq": max(most or 0, state.seq)}
        number = state.last + 1
        while not self._claim(number, record):
            if "base" in self._record(number):
                self._forget(commit)
                return
            number += 1

    def compact(self) -> None:
        """Write the current facts as a new snapshot; what it replaces stays until ``clean``."""
        self._snapshot(self._live)

    def rebuild(self) -> None:
        """A new snapshot of the facts put together again from their triples."""

        def rows(state: State) -> DataFrame:
            live = self._live(state)
            back = triples.reconstruct(triples.reify(live)).drop("seq").join(live.select("fact_id", "seq"), "fact_id")
            return back.select(*V.FACT.fieldNames())

        self._snapshot(rows)

    def clean(self) -> int:
        """Remove the commits that the last snapshot replaces; returns how many.  What is not yet committed stays."""
        state = self.state()
        records = [self._record(n) for n in self._numbers() if n < state.last or n == state.base_number]
        named = {r.get("base") or r["add"] for r in records}
        return sum(self._forget(c) for c in named - set(state.commits) - set(state.marked))

    # figures and checks

    def statistics(self) -> dict[str, float]:
        f = self.facts()
        row = f.agg(F.count("*").alias("facts"), F.count_distinct("subject").alias("subjects"), F.count_distinct("relation").alias("relations"), F.count_distinct("context").alias("contexts"), F.avg(F.size("objects")).alias("mean_arity"), F.avg("confidence").alias("mean_confidence")).first()
        return row.asDict() | {"triples": triples.reify(f).count(), "open_sets": topology.members(f).select("open_set").distinct().count()}

    def estimates(self) -> DataFrame:
        """Figures of all versions since the last snapshot, out of the sketches that each write has left: no fact is read."""
        paths = [f"{self.path}/sketches/commit={c}" for c in self.state().commits]
        return estimates.merged(self.spark.read.parquet(*paths))

    def verify(self, known: DataFrame | None = None) -> DataFrame:
        """(check, violations)."""
        f = self.facts()
        broken = validate.report(f, known).groupBy("message").agg(F.count("*").alias("violations")).select(F.col("message").alias("check"), "violations")
        clash = gluing.conflicts(self.versions()).agg(F.count("*").alias("violations")).select(F.lit("versions disagree").alias("check"), "violations")
        return broken.unionByName(clash)

    # exchange

    def export(self, path: str, form: str = "json") -> None:
        if form == "msgpack":
            msgpack.pack(self.facts()).write.mode("overwrite").parquet(path, compression="zstd")  # a row a fact: Spark writes no files of bytes alone
        elif form == "json":
            # Names and nulls in each line make JSON ten times as large as Parquet, but for compression.
            self.facts().write.mode("overwrite").option("ignoreNullFields", "false").json(path, compression="gzip")
        elif form == "parquet":
            self.facts().write.mode("overwrite").parquet(path)
        else:
            raise ValueError(f"unknown format {form!r}")

    def import_(self, path: str, form: str = "json") -> None:
        if form == "msgpack":
            self.insert(msgpack.unpack(self.spark.read.schema("msgpack binary").parquet(path), V.FACT))
            return
        reader = self.spark.read.schema(V.FACT)
        self.insert(reader.parquet(path) if form == "parquet" else reader.json(path))


def describe(q: access.Query) -> str:
    return json.dumps({k: v for k, v in vars(q).items() if v not in (None, (), 0)}, default=str)
