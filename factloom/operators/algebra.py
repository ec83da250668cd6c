"""Relational plan nodes: a small tree that compiles to one DataFrame, which Catalyst then optimises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.expressions import compile_expression

AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


class Node:
    def compile(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        raise NotImplementedError

    def describe(self, indent: int = 0) -> str:
        own = {k: v for k, v in vars(self).items() if not isinstance(v, Node)}
        lines = [" " * indent + type(self).__name__ + str(own)]
        lines += [v.describe(indent + 2) for v in vars(self).values() if isinstance(v, Node)]
        return "\n".join(lines)


@dataclass
class Scan(Node):
    table: str
    alias: str | None = None

    def compile(self, tables):
        df = tables[self.table]
        return df.alias(self.alias) if self.alias else df


@dataclass
class Seek(Node):
    """A scan with bound columns; the store's layout, not an index, makes it cheap."""

    table: str
    bound: Mapping[str, object]
    alias: str | None = None

    def compile(self, tables):
        df = tables[self.table]
        for c, v in self.bound.items():
            df = df.where(F.col(c) == F.lit(v))
        return df.alias(self.alias) if self.alias else df


@dataclass
class Filter(Node):
    child: Node
    condition: str

    def compile(self, tables):
        return self.child.compile(tables).where(compile_expression(self.condition))


@dataclass
class Project(Node):
    child: Node
    columns: Sequence[str]
    distinct: bool = False

    def compile(self, tables):
        df = self.child.compile(tables).select(*self.columns)
        return df.distinct() if self.distinct else df


@dataclass
class Join(Node):
    """Theta or equi join; the physical strategy is Spark's unless ``hint`` names one."""

    left: Node
    right: Node
    condition: str | None = None
    on: Sequence[str] = ()
    how: str = "inner"
    hint: str | None = None

    def compile(self, tables):
        a, b = self.left.compile(tables), self.right.compile(tables)
        if self.hint:
            b = b.hint(self.hint)
        if self.on:
            return a.join(b, list(self.on), self.how)
        return a.join(b, compile_expression(self.condition) if self.condition else None, self.how)


@dataclass
class Aggregate(Node):
    child: Node
    group: Sequence[str] = ()
    functions: Sequence[tuple[str, str, str]] = field(default_factory=list)
    """(function, column or ``*``, output name)"""

    def compile(self, tables):
        return self.child.compile(tables).groupBy(*self.group).agg(*(aggregate(f, c).alias(name) for f, c, name in self.functions))


def aggregate(function: str, column: str | Column) -> Column:
    f = AGGREGATES[function.upper()]
    if isinstance(column, str):
        column = F.lit(1) if column == "*" else F.col(column)
    return f(column)


@dataclass
class Sort(Node):
    child: Node
    keys: Sequence[tuple[str, bool]]
    """(column, ascending)"""

    def compile(self, tables):
        return self.child.compile(tables).orderBy(*(F.asc(c) if up else F.desc(c) for c, up in self.keys))


@dataclass
class Limit(Node):
    child: Node
    limit: int | None = None
    offset: int = 0

    def compile(self, tables):
        df = self.child.compile(tables)
        df = df.offset(self.offset) if self.offset else df
        return df if self.limit is None else df.limit(self.limit)


@dataclass
class Union(Node):
    left: Node
    right: Node
    distinct: bool = False

    def compile(self, tables):
        df = self.left.compile(tables).unionByName(self.right.compile(tables), allowMissingColumns=True)
        return df.distinct() if self.distinct else df
