"""Command line: ``python -m scriptorium status|catalogue|build|ingest|library ...``"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine
from .plans.build import build_editions, build_library, ingest


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("status", "catalogue"):
        sub.add_parser(name).add_argument("--data")
    for name, what in (("build", "index the editions of a folder"), ("ingest", "read the commentaries of a folder"), ("library", "add a folder of plain texts to the index")):
        one = sub.add_parser(name, help=what)
        one.add_argument("files")
        one.add_argument("--data", required=True)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("scriptorium").getOrCreate()
    if a.what == "build":
        build_editions(spark, a.files, a.data).show(200, truncate=False)
    elif a.what == "ingest":
        ingest(spark, a.files, a.data).show(200, truncate=False)
    elif a.what == "library":
        build_library(spark, a.files, a.data)
    engine = Engine(spark, a.data)
    (engine.catalogue() if a.what == "catalogue" else engine.status()).show(200, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
