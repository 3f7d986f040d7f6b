"""Command line: ``python -m stratagraph COMMAND ROOT``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="stratagraph")
    p.add_argument("command", choices=["extract", "coverage", "pending", "explain", "search", "callers", "callees", "symbol", "source", "features", "statistics", "report", "task", "backfill-dep-targets", "adopt"])
    p.add_argument("root")
    p.add_argument("argument", nargs="?", default="")
    p.add_argument("--pack")
    p.add_argument("--cursor", type=int, default=0)
    a = p.parse_args(argv)
    from stratagraph.engine import Engine

    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    e = Engine.build(spark, a.root, a.pack)
    if a.command == "backfill-dep-targets":
        print(e.backfill_dep_targets())
        return 0
    if a.command == "adopt":
        print(json.dumps(e.adopt()))
        return 0
    if a.command == "report":
        print(json.dumps(e.coverage_answer(a.argument, a.cursor)))
        return 0
    if a.command == "task":
        print(json.dumps(e.next_unit(a.argument, a.cursor)))
        return 0
    if a.command == "extract" and (bad := e.rel.files.where("parse_errors > 0").count()):
        print(f"{bad} files were read in part", file=sys.stderr)
    rows = {
        "extract": lambda: e.rel.symbols,
        "coverage": lambda: e.coverage_report(a.argument),
        "pending": lambda: e.pending(a.argument, a.cursor),
        "explain": lambda: e.explain(a.argument or None),
        "search": lambda: e.search_code(a.argument),
        "callers": lambda: e.get_callers(a.argument),
        "callees": lambda: e.get_callees(a.argument),
        "symbol": lambda: e.get_symbol(a.argument),
        "source": lambda: e.get_source(a.argument),
        "features": lambda: e.entry_points(),
        "statistics": lambda: e.statistics(),
    }[a.command]()
    for row in rows.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
