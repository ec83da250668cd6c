"""Seeded synthetic facts: everything from ``range`` and hashes of the row number, so any number of rows is made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(u: Column, n: int) -> Column:
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("long")


def zipf(u: Column, n: int, s: float) -> Column:
    """A rank below ``n`` with weight about 1 / (rank + 1) ** s, by the inverse of the continuous distribution."""
    if abs(s - 1) < 1e-9:
        x = F.pow(F.lit(float(n + 1)), u)
    else:
        x = F.pow(u * (float(n + 1) ** (1 - s) - 1) + 1, F.lit(1 / (1 - s)))
    return F.least(F.floor(x) - 1, F.lit(n - 1)).cast("long")


def context_tree(spark: SparkSession, depth: int = 3, branching: int = 3, root: str = "ctx") -> DataFrame:
    """All paths ``root.i.j..`` down to ``depth`` levels, and ``world``."""
    out = spark.createDataFrame([("world",), (root,)], "context string")
    level = out.where(F.col("context") == root)
    for _ in range(depth):
        level = level.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(branching - 1)), lambda k: F.concat("context", F.lit("."), k.cast("string")))).alias("context"))
        out = out.union(level)
    return out


def synthetic(spark: SparkSession, n: int = 1000, entities: int | None = None, relations: int = 20, arity: tuple[int, int] = (3, 8), depth: int = 3, branching: int = 3, skew: float = 1.2, temporal: float = 0.4, seed: int = 42) -> DataFrame:
    """``n`` facts over Zipf-distributed entities in a tree of contexts; a share of them has an interval."""
    entities = entities or max(20, n // 10)
    i = F.col("id")
    u = lambda *p: uniform(seed, i, *p)
    size = F.lit(arity[0]) + pick(u("arity"), arity[1] - arity[0] + 1)
    name = lambda k: F.concat(F.lit("entity_"), zipf(k, entities, skew).cast("string"))
    slot = F.transform(F.sequence(F.lit(1), size), lambda k: F.when(uniform(seed, i, k, "kind") < 0.6, V.ref(name(uniform(seed, i, k, "ref")))).when(uniform(seed, i, k, "kind") < 0.8, V.number(F.round(uniform(seed, i, k, "num") * 1000, 2))).otherwise(V.text(F.concat(F.lit("v"), pick(uniform(seed, i, k, "text"), 100).cast("string")))))
    level = pick(u("depth"), depth + 1)
    context = F.when(level == 0, F.lit("ctx")).otherwise(F.concat(F.lit("ctx."), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(level, F.lit(1))), lambda k: pick(uniform(seed, i, k, "branch"), branching).cast("string")), ".")))
    timed = u("timed") < temporal
    start = F.expr("timestamp_ntz'2015-01-01'") + F.make_dt_interval(pick(u("start"), 4000).cast("int"))
    end = F.when(u("open") < 0.7, start + F.make_dt_interval((pick(u("length"), 700) + 1).cast("int")))
    parts = {
        "fact_id": F.concat(F.lit("fact_"), i.cast("string")),
        "subject": name(u("subject")),
        "relation": F.concat(F.lit("relation_"), pick(u("relation"), relations).cast("string")),
        "objects": slot,
        "attributes": V.attributes_of(weight=V.number(F.round(u("weight"), 3))),
        "context": context,
        "confidence": F.round(F.lit(0.5) + u("confidence") / 2, 3),
        "provenance": F.struct(F.concat(F.lit("source_"), pick(u("source"), 5).cast("string")).alias("source"), F.expr("timestamp_ntz'2024-01-01'").alias("recorded_at"), F.lit(1.0).alias("confidence"), F.when(u("method") < 0.5, "manual").otherwise("inference").alias("method")),
        "valid_start": F.when(timed, start),
        "valid_end": F.when(timed, end),
        "metadata": F.lit(None),
        "seq": i,
    }
    return spark.range(n).select(*(parts[f.name].cast(f.dataType).alias(f.name) for f in V.FACT.fields))


def _link(df: DataFrame, relation: Column | str, context: Column | str = "world", confidence: float = 1.0, method: str = "generated") -> DataFrame:
    """(s, o) rows as facts of one reference."""
    parts = {
        "fact_id": F.concat(F.lit("link/"), F.sha2(F.concat_ws("|", "s", relation if isinstance(relation, Column) else F.lit(relation), "o"), 256)),
        "subject": F.col("s"),
        "relation": relation if isinstance(relation, Column) else F.lit(relation),
        "objects": F.array(V.ref(F.col("o"))),
        "attributes": F.expr(V.NO_ATTRIBUTES),
        "context": context if isinstance(context, Column) else F.lit(context),
        "confidence": F.lit(confidence),
        "provenance": F.struct(F.lit("generator").alias("source"), F.lit(None).cast("timestamp_ntz").alias("recorded_at"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")),
        "valid_start": F.lit(None),
        "valid_end": F.lit(None),
        "metadata": F.lit(None),
        "seq": F.lit(0),
    }
    return df.select(*(parts[f.name].cast(f.dataType).alias(f.name) for f in V.FACT.fields))


def graph(spark: SparkSession, nodes: int = 100, density: float = 0.05, seed: int = 42) -> DataFrame:
    """``connected_to`` between each pair i < j with probability ``density``; rows of the triangle are exploded where they lie."""
    pairs = spark.range(nodes).where(F.col("id") < nodes - 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id") + 1, F.lit(nodes - 1).cast("long"))).alias("j"))
    kept = pairs.where(uniform(seed, F.col("i"), F.col("j")) < density)
    return _link(kept.select(F.concat(F.lit("node_"), "i").alias("s"), F.concat(F.lit("node_"), "j").alias("o")), "connected_to")


def university(spark: SparkSession, universities: int = 1, departments: int = 3, professors: int = 4, students: int = 20, courses: int = 6, seed: int = 42) -> DataFrame:
    """Universities, departments and people, with who works, heads, teaches, studies, advises, belongs and writes where.

    A person has all types that hold: a chair is a professor, faculty and a
    person.  Choices go by MD5 of the name, the seed and what is chosen.
    """
    dept = spark.range(universities * departments).select(F.concat(F.lit("univ"), F.floor(F.col("id") / departments).cast("string")).alias("u"), F.concat(F.lit("univ"), F.floor(F.col("id") / departments).cast("string"), F.lit("/dept"), (F.col("id") % departments).cast("string")).alias("d"), F.concat(F.lit("world.univ"), F.floor(F.col("id") / departments).cast("string"), F.lit(".dept"), (F.col("id") % departments).cast("string")).alias("ctx"))

    def people(kind: str, n: int) -> DataFrame:
        return dept.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("*", F.concat("d", F.lit(f"/{kind}"), F.col("k").cast("string")).alias("x"))

    prof, stud, course = people("professor", professors), people("student", students), people("course", courses)
    drawn = lambda n, what: F.conv(F.substring(F.md5(F.concat("x", F.lit(f":{what}:{seed}"))), 1, 8), 16, 10).cast("long") % n
    some = lambda kind, n, what: F.concat("d", F.lit(f"/{kind}"), drawn(n, what).cast("string"))
    types = lambda df, *names: [_typed(df.select("ctx", F.col("x").alias("s"), F.lit(n).alias("o"))) for n in names]
    told = lambda df, relation, value: _link(df.select("ctx", F.col("x").alias("s"), value.alias("o")), relation, F.col("ctx")).withColumn("objects", F.transform("objects", lambda v: V.text(v["ref"])))
    graduate, paper, group = stud.where("k % 4 = 0"), prof.withColumn("x", F.concat("x", F.lit("/paper"))), dept.withColumn("x", F.concat("d", F.lit("/group")))
    univ = F.concat(F.lit("univ"), drawn(universities, "degree").cast("string"))
    rows = [
        _typed(dept.select("ctx", F.col("d").alias("s"), F.lit("Department").alias("o"))),
        *types(dept.select("ctx", F.col("u").alias("x")).dropDuplicates(["x"]).withColumn("ctx", F.concat(F.lit("world."), F.col("x"))), "University"),
        *types(prof, "Professor", "Faculty", "Person"),
        *types(prof.where("k = 0"), "Chair"),
        *types(stud, "Student", "Person"),
        *types(graduate, "GraduateStudent"),
        *types(stud.where("k % 4 <> 0"), "UndergraduateStudent"),
        *types(course, "Course"),
        *types(paper, "Publication"),
        *types(group, "ResearchGroup"),
        *(told(df, "emailAddress", F.concat("x", F.lit("@example.org"))) for df in (prof, stud)),
        told(prof, "name", F.concat(F.lit("Professor "), F.col("k").cast("string"))),
        told(prof, "telephone", F.concat(F.lit("555-"), F.col("k").cast("string"))),
        _link(group.select("ctx", F.col("x").alias("s"), F.col("u").alias("o")), "subOrganizationOf", F.col("ctx")),
        _link(graduate.select("ctx", F.col("x").alias("s"), univ.alias("o")), "undergraduateDegreeFrom", F.col("ctx")),
        _link(prof.select("ctx", F.col("x").alias("s"), univ.alias("o")), "doctoralDegreeFrom", F.col("ctx")),
        _link(dept.select("ctx", F.col("d").alias("s"), F.col("u").alias("o")), "subOrganizationOf", F.col("ctx")),
        _link(prof.select("ctx", F.col("x").alias("s"), F.col("d").alias("o")), "worksFor", F.col("ctx")),
        _link(prof.where("k = 0").select("ctx", F.col("x").alias("s"), F.col("d").alias("o")), "headOf", F.col("ctx")),
        _link(prof.select("ctx", F.col("x").alias("s"), some("course", courses, "teach").alias("o")), "teacherOf", F.col("ctx")),
        _link(stud.select("ctx", F.col("x").alias("s"), F.col("d").alias("o")), "memberOf", F.col("ctx")),
        _link(stud.select("ctx", F.col("x").alias("s"), some("course", courses, "take").alias("o")), "takesCourse", F.col("ctx")),
        _link(stud.select("ctx", F.col("x").alias("s"), some("professor", professors, "advise").alias("o")), "advisor", F.col("ctx")),
        _link(prof.select("ctx", F.concat("x", F.lit("/paper")).alias("s"), F.col("x").alias("o")), "publicationAuthor", F.col("ctx")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _typed(df: DataFrame) -> DataFrame:
    return _link(df, "rdf:type", F.col("ctx")).withColumn("objects", F.transform("objects", lambda v: V.text(v["ref"])))


def contextual(spark: SparkSession, n: int = 200, seed: int = 42) -> DataFrame:
    """High-arity facts (3, 5, 8 or 12 slots), with parents in a provenance DAG as metadata."""
    i = F.col("id")
    arity = F.element_at(F.array(*(F.lit(k) for k in (3, 5, 8, 12))), (i % 4 + 1).cast("int"))
    base = synthetic(spark, n, seed=seed)
    wide = spark.range(n).select(F.concat(F.lit("fact_"), i.cast("string")).alias("fact_id"), F.concat(F.lit("high_arity_"), arity.cast("string")).alias("r"), F.transform(F.sequence(F.lit(1), arity), lambda k: V.ref(F.concat(F.lit("entity_"), pick(uniform(seed, i, k, "slot"), max(20, n // 10)).cast("string")))).alias("o"), F.when(i > 0, F.to_json(F.struct(F.array(F.concat(F.lit("fact_"), F.floor(i / 2).cast("string")), F.concat(F.lit("fact_"), F.floor(i / 3).cast("string"))).alias("parents"), F.lit("merge").alias("transformation")))).alias("m"))
    return base.join(wide, "fact_id").withColumn("relation", F.col("r")).withColumn("objects", F.col("o")).withColumn("metadata", F.col("m")).select(*V.FACT.fieldNames())


GENERATORS = {"synthetic": synthetic, "graph": graph, "university": university, "contextual": contextual}
