"""Statements in three bucketed and sorted layouts, of which a pattern reads the one that its bound terms ask for.

``spo`` is dealt by subject, ``pos`` and ``osp`` by object, all into the same
number of buckets, so that two patterns that share a variable are joined bucket
by bucket without an exchange.  Terms that would fill a bucket by themselves
are kept out of the buckets: their statements lie in ``hot_s`` and ``hot_o``,
and joins on them are ordinary ones that adaptive execution can split.
What only some patterns will ask can be laid out alone: the tables that they
read, of the relations that they name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from factloom.functions import packs
from factloom.functions.staging import cut
from factloom.operators import triples

#: Layout: bucketed by, sorted by.
BUCKETED = {"spo": ("s", ("s", "p")), "pos": ("o", ("p", "o")), "osp": ("o", ("o", "s"))}
HOT = {"hot_s": "s", "hot_o": "o"}
SCHEMA = "s string, p string, o string, num double, fact_id string"
#: Statements of a bucket, of which a task sorts one at a time.
BUCKET_ROWS = 2_000_000
#: Groups of terms by hash, for each bucket, that are counted before terms are.
GROUPS = 64


def frequent(rows: DataFrame, ends: list[str], most: int, buckets: int) -> list[str]:
    """Terms of more than ``most`` rows at one of ``ends``, of which there are fewer than ``buckets`` an end.

    Groups of terms are counted first, without a shuffle of terms; then the
    terms of groups that have as many rows.
    """
    ends_of = F.explode(F.array(*(F.struct(F.lit(c).alias("end"), F.col(c).alias("term")) for c in ends)))
    group = F.pmod(F.xxhash64("term"), F.lit(GROUPS * buckets))
    terms = rows.select(ends_of.alias("t")).select("t.end", "t.term").where("term is not null").withColumn("g", group)
    large = terms.groupBy("end", "g").agg(F.count("*").alias("n")).where(F.col("n") > most).select("end", "g")
    often = terms.join(F.broadcast(large), ["end", "g"], "left_semi").groupBy("end", "term").agg(F.count("*").alias("n")).where(F.col("n") > most)  # fewer groups than buckets an end
    return sorted({r.term for r in often.select("term").collect()})


@dataclass(frozen=True)
class Layouts:
    """Layouts under a path, as tables of the session.  ``hot`` has at most 2 * ``buckets`` terms."""

    spark: SparkSession
    path: str
    buckets: int
    hot: frozenset[str]
    prefix: str
    tables: tuple[str, ...] = tuple(BUCKETED)

    @classmethod
    def build(cls, statements: DataFrame, path: str, buckets: int = 200, tables: tuple[str, ...] = tuple(BUCKETED), relations: tuple[str, ...] | None = None) -> Layouts:
        """Write the layouts of (s, p, o, num, fact_id), which are read once; or those of ``tables`` and ``relations`` alone, with what is hot.

        Statements may also come as a fact's at a time (``triples.grouped``), and are then dealt by subject so.
        ``buckets`` is the least number: there are as many more as keep a bucket at ``BUCKET_ROWS`` rows.
        """
        spark, path = statements.sparkSession, path.rstrip("/")
        rows = statements.select("s", "p", "o", "num", "fact_id")
        several = isinstance(rows.schema["p"].dataType, ArrayType)
        each = triples.apart if several else lambda df: df
        if relations is not None:
            rows = rows.where(F.arrays_overlap("p", F.array(*map(F.lit, relations))) if several else F.col("p").isin(*relations))
            each = lambda df, one=each: one(df).where(F.col("p").isin(*relations))
        held = cut(rows, "statements", "zstd")
        rows = each(held)
        ends = sorted({BUCKETED[name][0] for name in tables})
        n = rows.count()
        buckets = max(buckets, -(-n // BUCKET_ROWS))
        found = frequent(rows, ends, max(1, n // buckets), buckets)
        hot = spark.createDataFrame([(t,) for t in found], "term string")
        self = cls(spark, path, buckets, frozenset(found), f"layout_{uuid.uuid4().hex}", tuple(tables))
        side = lambda df, c, how: df.join(F.broadcast(hot), df[c] == hot["term"], how)  # noqa: E731  as many terms as two buckets' worth at most
        cold = lambda df, c: side(df, c, "left_anti").where(F.col(c).isNotNull())

        def deal(by: str, order: tuple[str, ...]) -> DataFrame:
            if not several:
                return cold(rows, by).repartition(buckets, by)
            if by == "s":
                return each(packs.dealt(cold(held, by), by, buckets, (by,)))
            kept = packs.dealt(held, by, buckets, order, ("p", "o", "num"), lambda x: x.isNotNull() & ~x.isin(found) if found else x.isNotNull())
            return kept if relations is None else kept.where(F.col("p").isin(*relations))

        dealt: dict[str, str] = {}
        for name in tables:
            by, order = BUCKETED[name]
            # What one table has dealt by an end, the next one by that end only sorts.
            out = (self.table(dealt[by]) if by in dealt else deal(by, order)).write.option("compression", "zstd")
            dealt.setdefault(by, name)
            out.bucketBy(buckets, by).sortBy(*order).option("path", f"{path}/{name}").saveAsTable(f"{self.prefix}_{name}")
        for name, by in HOT.items():
            if by in ends:
                side(rows, by, "left_semi").union(rows.where(F.col(by).isNull())).sortWithinPartitions("p", by).write.parquet(f"{path}/{name}", compression="zstd")
        spark.createDataFrame([(json.dumps({"buckets": buckets, "hot": found, "tables": list(tables)}),)], "text string").coalesce(1).write.text(f"{path}/about")
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Layouts:
        """Layouts that are there, as tables of this session."""
        path = path.rstrip("/")
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self = cls(spark, path, about["buckets"], frozenset(about["hot"]), f"layout_{uuid.uuid4().hex}", tuple(about.get("tables", BUCKETED)))
        for name in self.tables:
            by, order = BUCKETED[name]
            spark.sql(f"CREATE TABLE {self.prefix}_{name} ({SCHEMA}) USING parquet CLUSTERED BY ({by}) SORTED BY ({', '.join(order)}) INTO {self.buckets} BUCKETS LOCATION '{path}/{name}'")
        return self

    def close(self) -> None:
        """Forget the session's tables; the files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")

    def table(self, name: str) -> DataFrame:
        if name not in self.tables and HOT.get(name) not in {BUCKETED[t][0] for t in self.tables}:
            raise ValueError(f"{name} is not among the tables laid out: {', '.join(self.tables)}")
        if name in HOT:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        return self.spark.table(f"{self.prefix}_{name}")

    def choose(self, s: str | None = None, p: str | None = None, o: str | None = None) -> tuple[str, ...]:
        """The tables to read where these terms are bound: one bucket where a rare end is."""
        if s is not None:
            return ("hot_s",) if s in self.hot else ("spo",)
        if o is not None:
            return ("hot_o",) if o in self.hot else ("osp",) if p is None else ("pos",)
        return ("pos", "hot_o") if p is not None else ("spo", "hot_s")

    def scan(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Statements of the bound terms."""
        out = None
        for name in self.choose(s, p, o):
            rows = self.table(name)
            for column, value in (("s", s), ("p", p), ("o", o)):
                if value is not None:
                    rows = rows.where(F.col(column) == value)
            out = rows if out is None else out.unionByName(rows)
        return out

    def sides(self, first: str, second: str) -> list[tuple[DataFrame, DataFrame]]:
        """Pairs of tables whose joins on ``first`` ("s" or "o") of one and ``second`` of the other are together that of all statements."""
        cold = {"s": "spo", "o": "osp"}
        # What is hot is so for both ends: a term's statements lie either in buckets on both sides or in none.
        return [(self.table(cold[first]), self.table(cold[second])), (self.table(f"hot_{first}"), self.table(f"hot_{second}"))]
