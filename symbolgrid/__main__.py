"""Verbs of the command line: ``spark-submit`` or ``python -m symbolgrid VERB ROOT STORE [...]``.

build: scan everything anew; refresh: only what changed, or everything if there is no store yet;
stats: counts; query PREFIX FILE: ranked suggestions as JSON lines; clear: drop old versions.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from symbolgrid import model
from symbolgrid.model import Settings
from symbolgrid.operators import lookup
from symbolgrid.plans.engine import Engine, query_row

VERBS = ("build", "refresh", "stats", "query", "clear")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="symbolgrid", description=__doc__)
    out.add_argument("verb", choices=VERBS)
    out.add_argument("root", help="folder of the workspace")
    out.add_argument("store", help="folder of the store, which all executors share")
    out.add_argument("asked", nargs="*", help="query: the prefix and the file that it is typed in")
    out.add_argument("--limit", type=int, default=20)
    return out


def main(arguments: Sequence[str], spark: SparkSession | None = None) -> list[str]:
    """The lines that the verb prints."""
    given = parser().parse_args(arguments)
    if given.verb == "query" and len(given.asked) != 2:
        parser().error("query takes a prefix and a file")
    spark = spark or SparkSession.builder.appName("symbolgrid").getOrCreate()
    engine, told = Engine.open(spark, Settings(given.root), given.store), []
    if given.verb == "build" or (given.verb == "refresh" and engine.tables is None):
        counts = engine.build(lambda step, rows: told.append(json.dumps({"done": step, "rows": rows})))
        return [*told, json.dumps(counts)]
    if given.verb == "refresh":
        return [json.dumps({"changed": engine.refresh()})]
    if given.verb == "stats":
        return [json.dumps(engine.stats())]
    if given.verb == "clear":
        engine.close()
        return []
    asked = spark.createDataFrame([query_row(0, *given.asked, limit=given.limit)], model.QUERIES)
    return [r.value for r in lookup.as_lines(engine.query(asked).orderBy("position")).collect()]


if __name__ == "__main__":
    print("\n".join(main(sys.argv[1:])))
