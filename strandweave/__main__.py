"""``python -m strandweave list`` names the queries, ``run NAME --data DIR --out PATH`` writes one as Parquet; the other commands work on files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import queries
from .commands import COMMANDS


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name", choices=sorted(queries.QUERIES))
    run.add_argument("--data", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = commands.add_parser(name, help=(f.__doc__ or "").strip())
        for names, rest in options:
            sub.add_argument(*names, **rest)
    for name, sub in commands.choices.items():
        if name != "list":
            sub.add_argument("--out", required=True)
    given = parser.parse_args(arguments)
    if given.command == "list":
        for name, query in sorted(queries.QUERIES.items()):
            print(f"{name:28} {(query.__doc__ or '').strip().splitlines()[0]}")
        return
    spark = SparkSession.builder.appName(f"strandweave {given.command}").getOrCreate()
    out = queries.QUERIES[given.name](spark, given.data) if given.command == "run" else COMMANDS[given.command][0](spark, given)
    out.write.mode("overwrite").parquet(given.out)


if __name__ == "__main__":
    main()
