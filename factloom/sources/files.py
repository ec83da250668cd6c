"""Reading and writing facts as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.staging import cut
from factloom.operators import sets
from factloom.sources import generators

_SIMPLE = "subject string, relation string, objects array<string>, context string, confidence double"


def _simple(df: DataFrame) -> DataFrame:
    """Rows of (subject, relation, objects, context, confidence) as facts with their content as id."""
    df = df.where("subject is not null and relation is not null")
    parts = {
        "fact_id": F.concat(F.lit("fact/"), V.content_id("subject", "relation", "objects", "context")),
        "objects": F.transform(F.coalesce("objects", F.array().cast("array<string>")), lambda o: V.text(o)),
        "attributes": F.expr(V.NO_ATTRIBUTES),
        "context": F.coalesce("context", F.lit("world")),
        "confidence": F.coalesce("confidence", F.lit(1.0)),
        "provenance": F.struct(F.lit("file").alias("source"), F.lit(None).cast("timestamp_ntz").alias("recorded_at"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit("import").alias("method")),
        "valid_start": F.lit(None),
        "valid_end": F.lit(None),
        "metadata": F.lit(None),
        "seq": F.lit(0),
        "subject": F.col("subject"),
        "relation": F.col("relation"),
    }
    return df.select(*(parts[f.name].cast(f.dataType).alias(f.name) for f in V.FACT.fields))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array or object a file."""
    return _simple(spark.read.schema(_SIMPLE).json(path, multiLine=True))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return _simple(spark.read.schema(_SIMPLE).json(path))


_IRI, _LITERAL = r"<([^>]*)>", r'"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^<[^>]*>)?'


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples, line by line; IRIs and blank nodes are references, literals are text."""
    line = rf"^\s*(?:{_IRI}|(_:\S+))\s+{_IRI}\s+(?:{_IRI}|(_:\S+)|{_LITERAL})\s*\.\s*(?:#.*)?$"
    t = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    at = lambda k: F.regexp_extract("value", line, k)
    t = t.select("value", F.concat(at(1), at(2)).alias("s"), at(3).alias("p"), F.concat(at(4), at(5)).alias("r"), at(6).alias("l"))
    t = t.select(F.when(F.col("p") == "", F.raise_error(F.concat(F.lit("not an N-Triples line: "), "value"))).otherwise(F.col("s")).alias("s"), "p", "r", "l")
    obj = F.when(F.col("r") != "", V.ref(F.col("r"))).otherwise(V.text(_unescaped(F.col("l"))))
    return _triple_facts(t.select("s", "p", obj.alias("o")))


def _unescaped(c):
    for a, b in (("\\\\n", "\n"), ("\\\\t", "\t"), ('\\\\"', '"')):
        c = F.regexp_replace(c, a, b)
    return F.regexp_replace(c, r"\\\\", r"\\")


def _triple_facts(t: DataFrame) -> DataFrame:
    t = t.withColumn("confidence", F.lit(1.0))
    parts = {
        "fact_id": F.concat(F.lit("triple/"), V.content_id("s", "p", "o")),
        "subject": F.col("s"),
        "relation": F.col("p"),
        "objects": F.array("o"),
        "attributes": F.expr(V.NO_ATTRIBUTES),
        "context": F.lit("world"),
        "confidence": F.lit(1.0),
        "provenance": F.struct(F.lit("rdf").alias("source"), F.lit(None).cast("timestamp_ntz").alias("recorded_at"), F.lit(1.0).alias("confidence"), F.lit("import").alias("method")),
        "valid_start": F.lit(None),
        "valid_end": F.lit(None),
        "metadata": F.lit(None),
        "seq": F.lit(0),
    }
    return t.select(*(parts[f.name].cast(f.dataType).alias(f.name) for f in V.FACT.fields))


def _turtle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (file, text, id, declared) in; triples out, or the file and what is wrong with one of its records."""
    from factloom.sources import turtle

    names = ["file", "s", "p", "o", "is_ref", "error"]
    kinds = [pa.string()] * 4 + [pa.bool_(), pa.string()]
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            known = dict(d.split(" ", 1) for d in r["declared"] or [])
            base = known.pop("@base", "")
            try:
                out += [(r["file"], *t, None) for t in turtle.parse(r["value"], known, base, f"n{r['id']}")]
            except turtle.TurtleError as e:
                out.append((r["file"], None, None, None, None, str(e)))
        for lo in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out[lo : lo + 10_000]), kinds)], names=names)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Turtle, of which a large file is read by several tasks.

    Records end where a line ends with a full stop.  A file's declarations are
    gathered first; a file that declares something twice, or in which such a
    line end is no statement's (in a long literal, or a comment within a
    statement), is parsed as a whole by one task.  A file that is no Turtle
    raises.
    """
    shape = "file string, s string, p string, o string, is_ref boolean, error string"
    split = spark.read.option("lineSep", ".\n").text(path).select(F.input_file_name().alias("file"), F.concat("value", F.lit(".")).alias("value"), F.monotonically_increasing_id().alias("id"))
    # The last record has its own full stop, or none but white space.
    text = F.regexp_replace("value", r"\.\s*\.$", ".")
    split = split.withColumn("value", F.when(F.trim(F.regexp_replace("value", r"\s", "")) == ".", "").otherwise(text))
    # Declarations stand alone, or first in their record, where they need no full stop of their own.
    said = split.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?im)^\s*(@?(?:prefix|base)\s+(?:[\w.-]*:\s*)?<[^<>\"\s]*>)"), F.lit(1))).alias("d")).distinct()
    word = F.when(F.lower(F.regexp_extract("d", r"^@?(\w+)", 1)) == "base", "@base").otherwise(F.regexp_extract("d", r"\s([\w.-]*):\s*<", 1))
    named = said.select("file", word.alias("name"), F.regexp_extract("d", "<([^<>]*)>", 1).alias("iri")).distinct()
    declared = named.groupBy("file").agg(F.collect_list(F.concat_ws(" ", "name", "iri")).alias("declared"), (F.count("*") > F.count_distinct("name")).alias("twice"))
    rows = split.join(declared.select("file", "declared"), "file", "left").select("file", "value", "id", "declared")
    found = cut(rows.mapInArrow(_turtle_rows, shape), "turtle")
    whole = cut(found.where("error is not null").select("file").union(declared.where("twice").select("file")).distinct(), "turtle")
    triples = found.join(whole, "file", "left_anti")
    if not whole.isEmpty():
        texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").join(whole, "file", "left_semi")
        again = cut(texts.select("file", "value", F.xxhash64("file").alias("id"), F.lit(None).cast("array<string>").alias("declared")).mapInArrow(_turtle_rows, shape), "turtle")
        wrong = again.where("error is not null").select("file", "error").first()
        if wrong:
            raise ValueError(f"{wrong.file}: {wrong.error}")
        triples = triples.unionByName(again)
    return _triple_facts(triples.select("s", "p", F.when(F.col("is_ref"), V.ref(F.col("o"))).otherwise(V.text(F.col("o"))).alias("o")))


READERS = {"json": read_json, "jsonl": read_jsonl, "nt": read_ntriples, "ttl": read_turtle}


def load(spark: SparkSession, name: str, path: str | None = None, **options) -> DataFrame:
    """A data set by format, by file ending, or generated: ``synthetic``, ``graph``, ``university``, ``contextual``."""
    if name in generators.GENERATORS:
        return generators.GENERATORS[name](spark, **options)
    form = name if name in READERS or name == "parquet" else (path or name).rsplit(".", 1)[-1].lower()
    if form == "parquet":
        return spark.read.schema(V.FACT).parquet(path or name)
    if form not in READERS:
        raise ValueError(f"unknown data set {name!r}")
    return READERS[form](spark, path or name)


# Facts and results as files


def to_json(facts: DataFrame) -> DataFrame:
    """(fact_id, json) with keys in the schema's order, so equal facts give equal text."""
    return facts.select("fact_id", F.to_json(F.struct(*V.FACT.fieldNames()), {"ignoreNullFields": "false"}).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("json", V.FACT).alias("f")).select("f.*")


def rows_to_json(rows: DataFrame) -> DataFrame:
    """(json) of any rows, triples, sections and canonical tables among them: keys in the columns' order, nulls written."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def rows_from_json(lines: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns and types of ``like``."""
    return lines.select(F.from_json("json", like.schema).alias("r")).select("r.*")


def round_trips(facts: DataFrame, path: str) -> bool:
    """Whether facts come back unchanged from JSON text, JSON files and Parquet files.

    Text is compared row by row; files, which keep no order, by one grouping
    for all of them, as multisets.
    """
    spark, names = facts.sparkSession, V.FACT.fieldNames()
    facts = facts.select(*names)
    facts.write.mode("overwrite").parquet(f"{path}/p")
    facts.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/j", compression="gzip")
    backs = [spark.read.schema(V.FACT).parquet(f"{path}/p"), spark.read.schema(V.FACT).json(f"{path}/j")]
    text = facts.select(F.struct(*names).alias("f"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"))
    if not text.where(~F.col("f").eqNullSafe(F.from_json("json", V.FACT))).isEmpty():
        backs.append(from_json(to_json(facts)))  # rows that differ may still be each other's
    return sets.same_rows(facts, *backs)


def write_result(df: DataFrame, path: str, form: str, most: int = 10_000) -> None:
    """CSV, JSON and Parquet by Spark; Markdown and LaTeX tables of at most ``most`` rows as one text, larger ones are refused."""
    if form == "csv":
        df.write.mode("overwrite").option("header", "true").csv(path)
    elif form in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), form)(path)
    elif form in ("markdown", "latex"):
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a {form} table has at most {most} rows")
        text = markdown(df.columns, rows) if form == "markdown" else latex(df.columns, rows)
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {form!r}")


def markdown(columns: list[str], rows: list) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def latex(columns: list[str], rows: list) -> str:
    def cell(x):
        text = "" if x is None else str(x)
        for a in "&%$#_{}":
            text = text.replace(a, "\\" + a)
        return text

    body = [" & ".join(map(cell, r)) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", " & ".join(map(cell, columns)) + r" \\ \hline", *body, r"\end{tabular}"])
