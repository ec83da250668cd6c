"""A SQL-like language over facts, compiled to DataFrames.

``SELECT [DISTINCT] columns FROM table [?v] { WHERE c | FILTER(c) |
TEMPORAL(?v,'s','e') | CONTEXT(?v,'c') | PROVENANCE(?v,'s') |
NEIGHBORHOOD(?v,'e') | [INNER|LEFT] JOIN table ?w ON c | OPTIONAL table ?w ON c |
UNION select | GROUP BY columns | HAVING c | ORDER BY c [ASC|DESC], .. |
LIMIT n [OFFSET m] }``

Columns are ``*``, ``?v`` (the fact's id), ``?v.part`` and aggregates, each with
an optional ``AS name``.  A part is a fact's column, ``argN`` for the slot at N,
or the name of an attribute.  Clauses come in any order; errors raise.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import contexts, temporal
from factloom.functions import values as V
from factloom.operators.algebra import AGGREGATES
from factloom.plans.typed import condition


class LanguageError(ValueError):
    pass


_WORDS = "SELECT DISTINCT FROM WHERE FILTER TEMPORAL CONTEXT PROVENANCE NEIGHBORHOOD INNER LEFT JOIN ON OPTIONAL UNION GROUP BY HAVING ORDER ASC DESC LIMIT OFFSET AS".split()
_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<var>\?\w+(?:\.\w+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:\.\w+)?)|(?P<op><=|>=|!=|<>|&&|\|\||[(),*=<>+/-])""")
_FACT_COLUMNS = {f.name for f in V.FACT.fields}


@dataclass
class Item:
    source: str  # "*", a variable with or without part, or an identifier
    function: str | None
    name: str


@dataclass
class Statement:
    items: list[Item]
    table: str
    var: str
    distinct: bool = False
    conditions: list[str] = field(default_factory=list)
    predicates: list[tuple[str, list[str]]] = field(default_factory=list)
    joins: list[tuple[str, str, str, str | None]] = field(default_factory=list)  # (how, table, var, condition)
    unions: list[Statement] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    having: str | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise LanguageError(f"unexpected {text[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup:
            word = m.lastgroup == "name" and m[0].upper() in _WORDS
            out.append(("word", m[0].upper()) if word else (m.lastgroup, m[0]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def now(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "the end")

    def take(self, *words: str) -> bool:
        kind, word = self.now()
        if kind in ("word", "op") and word in words:
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise LanguageError(f"expected {word}, got {self.now()[1]}")

    def next(self, *kinds: str) -> str:
        kind, word = self.now()
        if kind not in kinds:
            raise LanguageError(f"expected {' or '.join(kinds)}, got {word}")
        self.at += 1
        return word

    def statement(self) -> Statement:
        self.need("SELECT")
        distinct, items = self.take("DISTINCT"), [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        table = self.next("name")
        out = Statement(items, table, self.next("var")[1:] if self.now()[0] == "var" else "", distinct)
        while self.now()[0] != "end":
            if self.take("WHERE"):
                out.conditions.append(self.until())
            elif self.take("FILTER"):
                self.need("(")
                out.conditions.append(self.inside())
            elif self.now()[1] in ("TEMPORAL", "CONTEXT", "PROVENANCE", "NEIGHBORHOOD") and self.now()[0] == "word":
                out.predicates.append(self.predicate())
            elif self.take("OPTIONAL"):
                out.joins.append(self.join("left"))
            elif self.take("INNER"):
                self.need("JOIN")
                out.joins.append(self.join("inner"))
            elif self.take("LEFT"):
                self.need("JOIN")
                out.joins.append(self.join("left"))
            elif self.take("JOIN"):
                out.joins.append(self.join("inner"))
            elif self.take("UNION"):
                out.unions.append(self.statement())
            elif self.take("GROUP"):
                self.need("BY")
                out.group = self.names()
            elif self.take("HAVING"):
                out.having = self.until()
            elif self.take("ORDER"):
                self.need("BY")
                out.order = self.orders()
            elif self.take("LIMIT"):
                out.limit = self.whole()
                if self.take("OFFSET"):
                    out.offset = self.whole()
            elif self.take("OFFSET"):
                out.offset = self.whole()
            else:
                raise LanguageError(f"unexpected {self.now()[1]}")
        return out

    def whole(self) -> int:
        if self.now()[1] == "-":
            raise LanguageError("LIMIT and OFFSET are not negative")
        word = self.next("num")
        if "." in word:
            raise LanguageError(f"{word} is no whole number")
        return int(word)

    def item(self) -> Item:
        if self.take("*"):
            return Item("*", None, "*")
        kind, word = self.now()
        self.next("var", "name")
        if kind == "name" and word.upper() in AGGREGATES and self.take("("):
            inner = "*" if self.take("*") else self.next("var", "name")
            self.need(")")
            name = self.next("name") if self.take("AS") else f"{word.lower()}_{_plain(inner)}"
            return Item(inner, word.upper(), name)
        return Item(word, None, self.next("name") if self.take("AS") else _plain(word))

    def names(self) -> list[str]:
        out = [self.next("var", "name")]
        while self.take(","):
            out.append(self.next("var", "name"))
        return out

    def orders(self) -> list[tuple[str, bool]]:
        out = []
        while True:
            name, up = self.next("var", "name"), not self.take("DESC")
            self.take("ASC")
            out.append((name, up))
            if not self.take(","):
                return out

    def predicate(self) -> tuple[str, list[str]]:
        name = self.next("word")
        self.need("(")
        args = [self.next("var")[1:]]
        while self.take(","):
            args.append(self.next("str", "name"))
        self.need(")")
        args[1:] = [None if a.upper() == "NULL" else a[1:-1] if a[0] in "'\"" else a for a in args[1:]]
        if len(args) < 2 or any(a == "" for a in args):
            raise LanguageError(f"{name} needs a variable and non-empty arguments")
        return name, args

    def join(self, how: str) -> tuple[str, str, str, str | None]:
        table, var = self.next("name"), self.next("var")[1:]
        return how, table, var, self.until() if self.take("ON") else None

    def inside(self) -> str:
        depth, parts = 1, []
        while True:
            kind, word = self.now()
            if kind == "end":
                raise LanguageError("a parenthesis is not closed")
            self.at += 1
            depth += (kind == "op") * ((word == "(") - (word == ")"))
            if not depth:
                return " ".join(parts)
            parts.append(word)

    def until(self) -> str:
        """A condition up to the next clause."""
        parts = []
        while self.now()[0] not in ("end", "word"):
            parts.append(self.now()[1])
            self.at += 1
        if not parts:
            raise LanguageError(f"expected a condition, got {self.now()[1]}")
        return " ".join(parts)


def _plain(name: str) -> str:
    return "all" if name == "*" else name.lstrip("?").replace(".", "_")


def parse(text: str) -> Statement:
    p = _Parser(text)
    return p.statement()


def check(s: Statement, tables: Mapping[str, DataFrame]) -> None:
    """Raise what Spark's own analysis would not say as plainly."""
    for t in [s.table, *(j[1] for j in s.joins)]:
        if t not in tables:
            raise LanguageError(f"unknown table {t}")
    if any(i.function for i in s.items) or s.group:
        loose = [i.source for i in s.items if not i.function and i.source not in s.group]
        if loose:
            raise LanguageError(f"{loose[0]} is neither grouped nor aggregated")
    known = {s.var, *(j[2] for j in s.joins)}
    for name, args in s.predicates:
        if args[0] not in known:
            raise LanguageError(f"{name} is about ?{args[0]}, which no table has")
    for u in s.unions:
        check(u, tables)
        if len(u.items) != len(s.items):
            raise LanguageError("both sides of UNION need as many columns")


class _Scope:
    """Names within one SELECT: each table variable is a prefix of its columns."""

    def __init__(self, vars_: list[str]):
        self.vars = vars_

    def column(self, var: str, part: str) -> Column:
        return F.col(f"`{var}`.`{part}`" if var else f"`{part}`")

    def slot(self, name: str) -> tuple[Column, Column]:
        """Text and number of a name."""
        name = name.lstrip("?")
        var, _, part = name.partition(".")
        if var not in self.vars:
            if part or not {""} & set(self.vars) and len(self.vars) > 1:
                raise LanguageError(f"unknown variable ?{var}")
            var, part = self.vars[0], name
        if not part:
            part = "fact_id"
        if re.fullmatch(r"arg\d+", part):
            v = F.get(self.column(var, "objects"), F.lit(int(part[3:])))
        elif part in _FACT_COLUMNS:
            c = self.column(var, part)
            return c, c.cast("double") if part in ("confidence", "seq") else F.lit(None).cast("double")
        elif part in ("source", "method"):
            c = self.column(var, "provenance")[part]
            return c, F.lit(None).cast("double")
        else:
            v = V.attribute(self.column(var, "attributes"), part)
        return V.as_text(v), V.as_number(v)


def run(text: str | Statement, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Compile and plan a statement; lazy like any DataFrame."""
    s = parse(text) if isinstance(text, str) else text
    check(s, tables)
    scope = _Scope([s.var, *(j[2] for j in s.joins)])
    df = tables[s.table].alias(s.var) if s.var else tables[s.table]
    for how, table, var, on in s.joins:
        df = df.join(tables[table].alias(var), condition(on, scope.slot) if on else None, how)
    for c in s.conditions:
        df = df.where(condition(c, scope.slot))
    for name, (var, *args) in s.predicates:
        df = df.where(_predicate(scope, name, var, args))
    out = _grouped(df, s, scope) if s.group or any(i.function for i in s.items) else _projected(df, s, scope)
    for u in s.unions:
        other = run(u, tables)
        out = out.union(other)
    if s.unions or s.distinct:
        out = out.distinct()
    if s.order:
        keys = [(F.col(_plain(n)) if _plain(n) in out.columns else F.col(n), up) for n, up in s.order]
        out = out.orderBy(*(k.asc() if up else k.desc() for k, up in keys))
    if s.offset:
        out = out.offset(s.offset)
    return out if s.limit is None else out.limit(s.limit)


def _predicate(scope: _Scope, name: str, var: str, args: list[str | None]) -> Column:
    if name == "TEMPORAL":
        lo, hi = temporal.bounds(args[0], args[1] if len(args) > 1 else None)
        return temporal.overlaps(scope.column(var, "valid_start"), scope.column(var, "valid_end"), lo, hi)
    if name == "CONTEXT":
        return contexts.under(scope.column(var, "context"), args[0])
    if name == "PROVENANCE":
        return scope.column(var, "provenance")["source"] == args[0]
    return (scope.column(var, "subject") == args[0]) | V.mentions(scope.column(var, "objects"), F.lit(args[0]))


def _typed(scope: _Scope, name: str) -> Column:
    """What a selected name shows: arguments and attributes as text, columns as they are."""
    return scope.slot(name)[0]


def _projected(df: DataFrame, s: Statement, scope: _Scope) -> DataFrame:
    cols: list[Column] = []
    for i in s.items:
        if i.source == "*":
            for v in scope.vars:
                cols += [scope.column(v, f).alias(f"{v}_{f}" if len(scope.vars) > 1 else f) for f in V.FACT.fieldNames()]
        else:
            cols.append(_typed(scope, i.source).alias(i.name))
    if s.order and not s.distinct and not s.unions:
        # Sort by what is not selected too: sort first, on typed values.
        have = {i.name for i in s.items}
        if any(_plain(n) not in have for n, _ in s.order):
            for n, up in reversed(s.order):
                text, num = scope.slot(n)
                df = df.orderBy(*(k.asc() if up else k.desc() for k in (num, text)))
            s.order = []
    return df.select(*cols)


def _grouped(df: DataFrame, s: Statement, scope: _Scope) -> DataFrame:
    keys = [_typed(scope, g).alias(_plain(g)) for g in s.group]
    aggs = []
    for i in s.items:
        if i.function:
            x = F.lit(1) if i.source == "*" else scope.slot(i.source)[0 if i.function == "COUNT" else 1]
            aggs.append(AGGREGATES[i.function](x).alias(i.name))
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    if s.having:
        out = out.where(condition(s.having, lambda n: (F.col(_plain(n)).cast("string"), F.col(_plain(n)).cast("double"))))
    return out.select(*((F.col(i.name) if i.function else F.col(_plain(i.source)).alias(i.name)) for i in s.items))
