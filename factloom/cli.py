"""Command line: ``python -m factloom.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from factloom.functions import staging
from factloom.operators.access import Kind, Query
from factloom.plans import planner, suite
from factloom.plans.planner import PROFILES
from factloom.plans.store import FactStore
from factloom.sources import files


def _session(profile: str) -> SparkSession:
    b = SparkSession.builder.appName("factloom").config("spark.sql.session.timeZone", "UTC")
    for k, v in PROFILES[profile].items():
        b = b.config(k, v)
    return b.getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("--profile", choices=sorted(PROFILES), default="default")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in {
        "init": [],
        "ingest": ["source", "--format"],
        "export": ["target", "--format"],
        "sparql": ["text"],
        "select": ["text"],
        "lookup": ["subject"],
        "statistics": [],
        "verify": [],
        "compact": [],
        "rebuild": [],
        "clean": [],
        "benchmark": ["--runs"],
        "profile": ["text"],
        "doctor": [],
        "dashboard": ["target"],
        "drop": [],
    }.items():
        s = sub.add_parser(name)
        s.add_argument("store")
        for x in extra:
            s.add_argument(x)
    a = p.parse_args(argv)
    spark = _session(a.profile)
    if a.command == "init":
        FactStore.create(spark, a.store)
        return 0
    store = FactStore(spark, a.store)
    if a.command == "ingest":
        store.insert(files.load(spark, a.format or a.source, a.source))
    elif a.command == "export":
        store.export(a.target, a.format or "json")
    elif a.command in ("sparql", "select"):
        getattr(store, a.command)(a.text).show(100, truncate=False)
    elif a.command == "lookup":
        store.query(Query(Kind.LOOKUP, subject=a.subject, limit=100)).show(100, truncate=False)
    elif a.command == "statistics":
        print(json.dumps(store.statistics(), default=str))
    elif a.command == "verify":
        found = store.verify()
        found.show(100, truncate=False)
        return int(not found.where("violations > 0").isEmpty())
    elif a.command in ("compact", "rebuild"):
        getattr(store, a.command)()
    elif a.command == "clean":
        print(store.clean())
    elif a.command == "benchmark":
        suite.measure(spark, store.facts(), int(a.runs or 3)).show(100, truncate=False)
    elif a.command == "profile":
        took = suite.seconds(lambda: store.select(a.text), 1)
        print(json.dumps({"seconds": took}))
        print(planner.explain(store.select(a.text)))
    elif a.command == "doctor":
        return int(not all(doctor(spark, store)))
    elif a.command == "dashboard":
        files.write_result(spark.createDataFrame([(k, str(v)) for k, v in store.statistics().items()], "figure string, value string"), a.target, "markdown")
    elif a.command == "drop":
        store.drop()
    return 0


def doctor(spark: SparkSession, store: FactStore) -> list[bool]:
    """Prints and returns what is well: the versions, the shared folder, the store."""

    def tried(what) -> str | None:
        try:
            return str(what())
        except Exception as broken:  # a diagnosis reports whatever is wrong
            print(f"  {type(broken).__name__}: {str(broken).splitlines()[0]}")
            return None

    checks = {"spark": lambda: spark.version, "shared folder": lambda: staging.shared_dir(spark), "facts": lambda: store.facts().count()}
    out = []
    for name, what in checks.items():
        found = tried(what)
        print(f"{name}: {'broken' if found is None else found}")
        out.append(found is not None)
    return out


if __name__ == "__main__":
    sys.exit(main())
