"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed into cells of (source, language, topic).  The cell
weights are raked: scaled to one marginal after the other, round after round,
until all three hold.  A document is then kept with the probability its cell
has been given, decided by a hash of its id, so that a rerun keeps the same.

A chance ends at 1, so ``mix`` and ``sample`` cannot give a cell more tokens than
it has, and miss the targets of scarce sources, languages and topics.  ``fill``
meets them: it repeats documents, each as often as its cell's weight asks for.

The cells' number is bounded by the distinct combinations, not by the
documents; each scaling is a windowed sum over one dimension, and the chain of
scalings refers to every step once, so the plan grows linearly.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.work import Workspace, spare_name

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of scaling at a time; more follow until no margin is off by more than ``TOLERANCE`` of all tokens, ``TURNS`` times at most.
ROUNDS, TOLERANCE, TURNS = 8, 1e-3, 20
CALIBRATIONS = 4
#: Exponents that temper each dimension's own shares into its target shares: 1 keeps them, 0 makes them equal.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.3}
#: Share of all tokens to keep.
RATE = 0.5


def topic_of(tokens: Column) -> Column:
    """Register of a text by its length, the topic this corpus knows without labels."""
    return F.when(tokens < 50, "note").when(tokens < 400, "article").otherwise("longform")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the three keys (null as ``null``, a value v as ``=v``) and the token count of every row."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), key("source").alias("source"), key("lang").alias("lang"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"))
    return slim.withColumn("topic", topic_of(F.col("tokens")))


Targets = Mapping[str, Mapping[str, float]]


def rake(cells: DataFrame, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, targets: Targets | None = None) -> DataFrame:
    """``cells`` (the keys, ``w0``, perhaps ``w`` of rounds before) with the raked weight ``w``; cells without tokens keep weight 0.

    ``targets`` gives weights by dimension and value, in any unit; a value that
    is not named there gets nothing.  A dimension without targets has its own
    shares, tempered.
    """
    total = cells.agg(F.sum("w0")).first()[0] or 0.0
    out = cells if "w" in cells.columns else cells.withColumn("w", F.col("w0"))
    if not total:
        return out
    for dim, power in temper.items():
        if dim in (targets or {}):
            have = {r[0] for r in cells.where("w0 > 0").select(dim).distinct().where(F.col(dim).isin(*targets[dim])).collect()}
            named = {v: x for v, x in targets[dim].items() if v in have and x > 0}
            if not named:
                raise ValueError(f"no target of {dim} is among its values")
            weight = F.lit(0.0)
            for v, x in named.items():
                weight = F.when(F.col(dim) == v, F.lit(x / sum(named.values()) * total)).otherwise(weight)
            out = out.withColumn(f"to_{dim}", weight)
            continue
        share = cells.groupBy(dim).agg(F.sum("w0").alias("m")).where("m > 0")
        norm = share.agg(F.sum(F.pow(F.col("m") / total, F.lit(power)))).first()[0]
        own = F.sum("w0").over(W.partitionBy(dim)) / total
        out = out.withColumn(f"to_{dim}", F.pow(own, F.lit(power)) / norm * total)
    for _ in range(rounds):
        for dim in temper:
            now = F.sum("w").over(W.partitionBy(dim))
            out = out.withColumn("w", F.when(now > 0, F.col("w") * F.col(f"to_{dim}") / now).otherwise(F.lit(0.0)))
    return out.drop(*(f"to_{d}" for d in temper))


def margins(cells: DataFrame, temper: Mapping[str, float] = TEMPER, targets: Targets | None = None, weight: str = "w") -> DataFrame:
    """(dim, value, target, share): what each margin should have of all tokens and what ``weight`` gives it."""
    total = cells.agg(F.sum(weight)).first()[0] or 1.0
    aimed = cells.agg(F.sum("w0")).first()[0] or 1.0
    out = None
    for dim in temper:
        own = rake(cells.drop("w"), {dim: temper[dim]}, 1, targets)  # one scaling meets one margin
        sums = own.groupBy(dim).agg(F.sum("w").alias("t")).join(cells.groupBy(dim).agg(F.sum(weight).alias("s")), dim)
        one = sums.select(F.lit(dim).alias("dim"), F.col(dim).alias("value"), (F.col("t") / aimed).alias("target"), (F.col("s") / total).alias("share"))
        out = one if out is None else out.unionByName(one)
    return out


def raked(cells: DataFrame, ws: Workspace, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, targets: Targets | None = None) -> DataFrame:
    """``rake`` until all margins hold; where they cannot, as no cell has what a target asks for, as near as ``TURNS`` times come."""
    now = ws.table(rake(cells, temper, rounds, targets), "raked-0")
    for turn in range(1, TURNS):
        off = margins(now, temper, targets).agg(F.max(F.abs(F.col("target") - F.col("share")))).first()[0]
        if off is None or off <= TOLERANCE:
            break
        now = ws.table(rake(now, temper, rounds, targets), f"raked-{turn}")
    return now


def calibrated(cells: DataFrame, rate: float = RATE, steps: int = CALIBRATIONS) -> DataFrame:
    """Raked cells with ``p``, the chance to keep a document: proportional to w/w0, at most 1.

    The factor is set so that ``rate`` of all tokens are expected to stay; each
    step shares out what the cells that have reached 1 leave over.
    """
    total = cells.agg(F.sum("w0")).first()[0] or 0.0
    ratio = F.when(F.col("w0") > 0, F.col("w") / F.col("w0")).otherwise(F.lit(0.0))
    cells = cells.withColumn("ratio", ratio)
    factor = rate
    for _ in range(steps):
        full = F.col("ratio") * factor >= 1
        got = cells.agg(F.sum(F.when(full, F.col("w0")).otherwise(0.0)).alias("at_one"), F.sum(F.when(~full, F.col("w")).otherwise(0.0)).alias("rest")).first()
        if not got["rest"]:
            break
        factor = max(factor, (rate * total - got["at_one"]) / got["rest"])
    return cells.withColumn("p", F.when(F.col("w0") > 0, F.least(F.lit(1.0), F.col("ratio") * F.lit(factor))).otherwise(F.lit(float(rate))))


def expected(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """Raked cells with ``e``, how often a document is to be drawn: w/w0 times ``rate``, also above 1, so that all margins hold."""
    return cells.withColumn("e", F.when(F.col("w0") > 0, F.col("w") / F.col("w0") * rate).otherwise(F.lit(float(rate))))


def chance(id_col: str, seed: int = 17) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, rate: float = RATE, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", targets: Targets | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, tokens, p, kept.

    ``targets`` are weights by source, lang or topic; values are named as the
    result names them (``=web`` for the source web).

    Defined results: a null source or language is a value of its own; a null
    text has no token.  Rows without tokens weigh nothing in the raking; in a
    cell of only such rows the chance is ``rate``.  Rows with one id share one
    draw.  An empty input gives an empty result.  Other columns are not read.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = ws.table(measured(docs, id_col, text_col), "measured")
    keys = ["source", "lang", "topic"]
    cells = ws.table(rows.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("w0")), "cells")
    p = calibrated(raked(cells, ws, temper, rounds, targets), rate).select(*keys, "p")
    return rows.join(p, keys).select("doc_id", *keys, "tokens", F.round("p", 6).alias("p"), (chance("doc_id", seed) < F.col("p")).alias("kept"))


def _placed(docs: DataFrame, chances, name: str, temper: Mapping[str, float], rounds: int, id_col: str, text_col: str, targets: Targets | None) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the tokens, keys and ``name`` of each row's cell, and what these columns are called."""
    ws = Workspace(docs.sparkSession, "mixing")
    keys = ["source", "lang", "topic"]
    rows = ws.table(measured(docs, id_col, text_col).drop("doc_id"), "measured")
    cells = ws.table(rows.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("w0")), "cells")
    p = chances(raked(cells, ws, temper, rounds, targets))
    mine = {c: spare_name(f"mix_{c}", docs.columns) for c in [*keys, name]}
    tokens = spare_name("tokens", docs.columns)
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    out = docs.withColumn(tokens, count).withColumns({mine["source"]: key("source"), mine["lang"]: key("lang"), mine["topic"]: topic_of(F.col(tokens))})
    out = out.join(p.select(*(F.col(c).alias(mine[c]) for c in keys), F.col(name).alias(mine[name])), [mine[c] for c in keys])
    return out, mine | {"tokens": tokens}


def sample(docs: DataFrame, rate: float = RATE, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns and topic, tokens and p (named apart if they clash).

    The same draws as ``mix`` marks as kept; only the cells' chances are joined.
    """
    out, mine = _placed(docs, lambda cells: calibrated(cells, rate), "p", temper, rounds, id_col, text_col, targets)
    out = out.where(chance(id_col, seed) < F.col(mine["p"]))
    return out.select(*docs.columns, F.col(mine["topic"]).alias(spare_name("topic", docs.columns)), mine["tokens"], F.col(mine["p"]).alias(spare_name("p", docs.columns)))


def fill(docs: DataFrame, rate: float = RATE, temper: Mapping[str, float] = TEMPER, rounds: int = ROUNDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with their columns and topic, tokens and p (named apart if they clash).

    ``p`` is how often a row is expected: the whole part of it is sure, the
    rest is drawn by the hash of the id.  Above 1 documents repeat; rows
    without tokens add to no share and come once at most.
    """
    out, mine = _placed(docs, lambda cells: expected(cells, rate), "e", temper, rounds, id_col, text_col, targets)
    e = F.when(F.col(mine["tokens"]) > 0, F.col(mine["e"])).otherwise(F.least(F.lit(1.0), F.col(mine["e"])))
    copies = (F.floor(e) + (chance(id_col, seed) < e - F.floor(e)).cast("long")).cast("int")
    copy = spare_name("copy", [*out.columns])
    out = out.withColumn(mine["e"], e).where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return out.select(*docs.columns, F.col(mine["topic"]).alias(spare_name("topic", docs.columns)), mine["tokens"], F.col(mine["e"]).alias(spare_name("p", docs.columns)))
