"""A SPARQL subset compiled to joins over statements (s, p, o, num).

``[PREFIX n: <iri>] SELECT [DISTINCT] vars|*|(AGG(?x) AS ?y) WHERE { patterns OPTIONAL {..} UNION
{ SELECT .. } BIND(EXISTS {..} AS ?x) FILTER [NOT] EXISTS {..} FILTER(..) }
[GROUP BY ..] [HAVING (..)] [ORDER BY [ASC|DESC] ?v ..] [LIMIT n] [OFFSET m]``

``;`` repeats a subject and ``,`` a subject and predicate; ``a`` is
``rdf:type``.  Order of evaluation in a group: patterns, unions, sub-selects,
optionals, EXISTS, filters; then group, project, distinct, order, offset, limit.
A sub-select sees its own variables alone and gives those that it selects.
EXISTS asks for a solution that agrees on the variables both sides have: a semi
or anti join, or, bound to a variable, a left join with what exists.  Bad
syntax raises.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.algebra import AGGREGATES
from factloom.plans.layouts import Layouts
from factloom.plans.typed import condition


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    kind: str  # "var", "text" or "num"
    value: object


@dataclass(frozen=True)
class Pattern:
    s: Term
    p: Term
    o: Term

    def vars(self) -> set[str]:
        return {t.value for t in (self.s, self.p, self.o) if t.kind == "var"}


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    selects: list[Select] = field(default_factory=list)
    binds: list[tuple[str, Group]] = field(default_factory=list)  # (variable, what exists)
    exists: list[tuple[bool, Group]] = field(default_factory=list)  # (whether it has to, what)


@dataclass
class Select:
    columns: list[tuple[str, str, str | None]]  # (name, variable or *, aggregate)
    where: Group
    distinct: bool = False
    group: list[str] = field(default_factory=list)
    having: str | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<var>\?\w+)|(?P<iri><[^<>\s]*>)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>[+-]?\d+(?:\.\d+)?(?![\w/]))|(?P<name>[\w][\w:/#.-]*[\w/#]|\w)|(?P<op>&&|\|\||<=|>=|!=|[{}().;,*=<>!+/:-])""")


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"unexpected {text[at : at + 10]!r}")
        at = m.end()
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0
        self.prefixes: dict[str, str] = {}

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].upper() in words and self.tokens[self.at][0] != "str"

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise SparqlError(f"expected {' or '.join(words)}, got {got}")

    def next(self, *kinds: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise SparqlError(f"expected {' or '.join(kinds)}, got {got}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def var(self) -> str:
        return self.next("var")[1:]

    def parse(self) -> Select:
        while self.take("PREFIX"):
            name = "" if self.peek(":") else self.next("name")
            self.need(":")
            self.prefixes[name] = self.next("iri")[1:-1]
        out = self.select()
        if self.at < len(self.tokens):
            raise SparqlError(f"unexpected {self.tokens[self.at][1]}")
        return out

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        columns = []
        while not self.peek("WHERE", "{"):
            if self.take("*"):
                columns.append(("*", "*", None))
            elif self.take("("):
                columns.append(self.aggregate())
            else:
                v = self.var()
                columns.append((v, v, None))
        if not columns:
            raise SparqlError("nothing is selected")
        self.take("WHERE")
        out = Select(columns, self.group(), distinct)
        while self.at < len(self.tokens) and not self.peek("}"):
            if self.take("GROUP"):
                self.need("BY")
                while self.at < len(self.tokens) and self.tokens[self.at][0] == "var":
                    out.group.append(self.var())
            elif self.take("HAVING"):
                out.having = self.raw()
            elif self.take("ORDER"):
                self.need("BY")
                while self.at < len(self.tokens) and (self.tokens[self.at][0] == "var" or self.peek("ASC", "DESC")):
                    up = not self.take("DESC")
                    self.take("ASC")
                    wrapped = self.take("(")
                    out.order.append((self.var(), up))
                    if wrapped:
                        self.need(")")
            elif self.take("LIMIT"):
                out.limit = int(self.next("num"))
            elif self.take("OFFSET"):
                out.offset = int(self.next("num"))
            else:
                raise SparqlError(f"unexpected {self.tokens[self.at][1]}")
        if (out.limit or 0) < 0 or out.offset < 0:
            raise SparqlError("LIMIT and OFFSET are not negative")
        return out

    def aggregate(self) -> tuple[str, str, str]:
        f = self.next("name").upper()
        if f not in AGGREGATES:
            raise SparqlError(f"unknown aggregate {f}")
        self.need("(")
        if self.take("DISTINCT"):
            f += " DISTINCT"
        v = "*" if self.take("*") else self.var()
        self.need(")")
        self.need("AS")
        name = self.var()
        self.need(")")
        return name, v, f

    def raw(self) -> str:
        """A parenthesised condition as text."""
        self.need("(")
        depth, parts = 1, []
        while depth:
            if self.at >= len(self.tokens):
                raise SparqlError("a parenthesis is not closed")
            kind, word = self.tokens[self.at]
            self.at += 1
            depth += (kind == "op") * ((word == "(") - (word == ")"))
            if depth:
                parts.append(word)
        return " ".join(parts)

    def group(self) -> Group:
        self.need("{")
        out = Group()
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                if self.peek("NOT", "EXISTS"):
                    has = not self.take("NOT")
                    self.need("EXISTS")
                    out.exists.append((has, self.group()))
                else:
                    out.filters.append(self.raw())
            elif self.take("BIND"):
                for word in ("(", "EXISTS"):
                    self.need(word)
                what = self.group()
                self.need("AS")
                out.binds.append((self.var(), what))
                self.need(")")
            elif self.take("OPTIONAL"):
                out.optionals.append(self.group())
            elif self.peek("{") and self.tokens[self.at + 1 : self.at + 2] and self.tokens[self.at + 1][1].upper() == "SELECT":
                self.need("{")
                out.selects.append(self.select())
                self.need("}")
            elif self.peek("{"):
                sides = [self.group()]
                while self.take("UNION"):
                    sides.append(self.group())
                out.unions.append(sides)
            else:
                self.block(out)
        return out

    def block(self, out: Group) -> None:
        s = self.term()
        while True:
            p = self.term()
            while True:
                out.patterns.append(Pattern(s, p, self.term()))
                if not self.take(","):
                    break
            if not self.take(";") or self.peek(".", "}"):
                return

    def term(self) -> Term:
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else "the end"
        word = self.next("var", "iri", "str", "num", "name")
        if kind == "var":
            return Term("var", word[1:])
        if kind == "iri":
            return Term("text", word[1:-1])
        if kind == "str":
            return Term("text", re.sub(r"\\(.)", r"\1", word[1:-1]))
        if kind == "num":
            return Term("num", float(word))
        prefix, colon, local = word.partition(":")
        if colon and prefix in self.prefixes:
            return Term("text", self.prefixes[prefix] + local)
        return Term("text", "rdf:type" if word == "a" else word)


def parse(text: str) -> Select:
    return _Parser(text).parse()


# Every variable is two columns: its text and, beside it, its number.
_NUM = "#num"


def _pattern(statements: DataFrame | Layouts, p: Pattern) -> DataFrame:
    if isinstance(statements, Layouts):
        bound = {c: t.value for c, t in (("s", p.s), ("p", p.p), ("o", p.o)) if t.kind == "text"}
        statements = statements.scan(**bound)
    df, named = statements, {}
    for column, term in (("s", p.s), ("p", p.p), ("o", p.o)):
        if term.kind == "text":
            df = df.where(F.col(column) == term.value)
        elif term.kind == "num":
            if column != "o":
                raise SparqlError("a number can only be an object")
            df = df.where(F.col("num") == term.value)
        elif term.value in named:
            df = df.where(F.col(column) == F.col(named[term.value]))
        else:
            named[term.value] = column
    cols = []
    for v, c in named.items():
        cols += [F.col(c).alias(v), (F.col("num") if c == "o" else F.lit(None).cast("double")).alias(v + _NUM)]
    return df.select(*cols) if cols else df.select(F.lit(1).alias("#any")).limit(1)


def _vars(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.endswith(_NUM) and c != "#any"]


def _join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    shared = [v for v in _vars(a) if v in _vars(b)]
    if not shared:
        return a.crossJoin(b) if how == "inner" else a.join(b, F.lit(True), how)
    # The number of a shared variable comes from whichever side has it as an object.
    b = b.select(*(F.col(f"`{c}`").alias(c + "#right") if c[: -len(_NUM)] in shared and c.endswith(_NUM) else F.col(f"`{c}`") for c in b.columns))
    out = a.join(b, shared, how)
    for v in shared:
        out = out.withColumn(v + _NUM, F.coalesce(F.col(f"`{v}{_NUM}`"), F.col(f"`{v}{_NUM}#right`"))).drop(f"{v}{_NUM}#right")
    return out


def _ordered(patterns: list[Pattern]) -> list[Pattern]:
    """Most bound terms first, then whatever shares a variable with what is there already."""
    rest = sorted(patterns, key=lambda p: len(p.vars()))
    out, have = [], set()
    while rest:
        k = next((k for k, p in enumerate(rest) if not out or p.vars() & have), 0)
        out.append(rest.pop(k))
        have |= out[-1].vars()
    return out


def _pair(layouts: Layouts, a: Pattern, b: Pattern) -> DataFrame | None:
    """Two patterns without bound ends joined bucket by bucket, where one variable is an end of both and all that they share."""
    if any(t.kind != "var" for p in (a, b) for t in (p.s, p.o)):
        return None  # a bound end picks out one bucket, which is less to read
    ends = lambda p: {t.value: c for c, t in (("s", p.s), ("o", p.o)) if t.kind == "var"}
    shared = a.vars() & b.vars()
    if len(shared) != 1 or not shared <= set(ends(a)) & set(ends(b)):
        return None
    v = shared.pop()
    (cold_a, cold_b), (hot_a, hot_b) = layouts.sides(ends(a)[v], ends(b)[v])
    return _join(_pattern(cold_a, a), _pattern(cold_b, b)).unionByName(_join(_pattern(hot_a, a), _pattern(hot_b, b)))


def _evaluate(statements: DataFrame | Layouts, g: Group) -> DataFrame:
    out, patterns = None, _ordered(g.patterns)
    if isinstance(statements, Layouts) and len(patterns) > 1:
        out = _pair(statements, *patterns[:2])
        patterns = patterns if out is None else patterns[2:]
    for p in patterns:
        step = _pattern(statements, p)
        out = step if out is None else _join(out, step)
    for sides in g.unions:
        both = _evaluate(statements, sides[0])
        for side in sides[1:]:
            both = both.unionByName(_evaluate(statements, side), allowMissingColumns=True)
        out = both if out is None else _join(out, both)
    for q in g.selects:
        inner = _solve(statements, q)
        out = inner if out is None else _join(out, inner)
    if out is None:
        raise SparqlError("a group has no pattern")
    for o in g.optionals:
        out = _join(out, _evaluate(statements, o), "left")
    for v, what in g.binds:
        if v in out.columns:
            raise SparqlError(f"?{v} is bound already")
        there, shared = _agreeing(out, _evaluate(statements, what))
        out = out.join(there.withColumn(v, F.lit("true")), shared, "left")
        out = out.withColumn(v, F.coalesce(F.col(f"`{v}`"), F.lit("false"))).withColumn(v + _NUM, F.lit(None).cast("double"))
    for has, what in g.exists:
        there, shared = _agreeing(out, _evaluate(statements, what))
        out = out.join(there, shared, "left_semi" if has else "left_anti")
    for f in g.filters:
        out = out.where(condition(f, _reader(out)))
    return out


def _agreeing(out: DataFrame, inner: DataFrame) -> tuple[DataFrame, list[str]]:
    """What ``inner`` has of the variables of ``out``, each once."""
    shared = [v for v in _vars(inner) if v in _vars(out)]
    if not shared:
        raise SparqlError("EXISTS shares no variable with its group")
    return inner.select(*(F.col(f"`{v}`") for v in shared)).distinct(), shared


def _reader(df: DataFrame):
    def read(name: str) -> tuple[Column, Column]:
        if name not in df.columns:
            raise SparqlError(f"unknown variable ?{name}")
        number = F.col(f"`{name}{_NUM}`") if name + _NUM in df.columns else F.col(f"`{name}`").cast("double")
        return F.col(f"`{name}`").cast("string"), number

    return read


def run(statements: DataFrame | Layouts, text: str | Select, numbers: Sequence[str] = ()) -> DataFrame:
    """One column a selected variable, as text; those in ``numbers`` as numbers.  Aggregates are numbers."""
    q = parse(text) if isinstance(text, str) else text
    df, names = _ranged(statements, q)
    return df.select(*(F.col(f"`{n}{_NUM}`").alias(n) if n in numbers else F.col(n) for n in names))


def _solve(statements: DataFrame | Layouts, q: Select) -> DataFrame:
    """A sub-select as a group's solutions: text and number of each selected variable."""
    df, names = _ranged(statements, q)
    number = lambda n: F.col(f"`{n}{_NUM}`") if n + _NUM in df.columns else F.col(f"`{n}`").cast("double")
    return df.select(*(c for n in names for c in (F.col(f"`{n}`").cast("string").alias(n), number(n).alias(n + _NUM))))


def _ranged(statements: DataFrame | Layouts, q: Select) -> tuple[DataFrame, list[str]]:
    """The rows of a select and the names of what it selects."""
    df = _evaluate(statements, q.where)
    found = _vars(df)
    has_agg = any(f for _, _, f in q.columns)
    if has_agg or q.group:
        loose = [v for _, v, f in q.columns if not f and v not in q.group]
        if loose:
            raise SparqlError(f"?{loose[0]} is neither grouped nor aggregated")
        aggs = []
        for name, v, f in q.columns:
            if f:
                aggs.append(_aggregate(df, v, f).alias(name))
        df = df.groupBy(*q.group).agg(*aggs) if aggs else df.select(*q.group).distinct()
        if q.having:
            df = df.where(condition(q.having, _reader(df)))
        names = [n for n, _, _ in q.columns]
    else:
        names = [x for n, v, _ in q.columns for x in (found if v == "*" else [n])]
        for n in names:
            if n not in found:
                df = df.withColumn(n, F.lit(""))
    order = []
    for v, up in q.order:
        keys = [F.col(f"`{c}`") for c in (v + _NUM, v) if c in df.columns]
        if not keys:
            raise SparqlError(f"unknown variable ?{v}")
        order += [k.asc() if up else k.desc() for k in keys]
    if q.distinct:
        df = df.dropDuplicates(names)
    if order:
        df = df.orderBy(*order)
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(q.limit)
    return df, names


def _aggregate(df: DataFrame, v: str, f: str) -> Column:
    if v == "*":
        return F.count(F.lit(1))
    if v not in df.columns:
        raise SparqlError(f"unknown variable ?{v}")
    if f == "COUNT DISTINCT":
        return F.count_distinct(v)
    if f == "COUNT":
        return F.count(v)
    if f.endswith(" DISTINCT"):
        raise SparqlError("only COUNT takes DISTINCT")
    return AGGREGATES[f](F.col(f"`{v}{_NUM}`"))
