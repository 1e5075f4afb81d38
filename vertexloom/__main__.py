"""Generates a graph and writes it: `python -m vertexloom FORMAT SPEC PATH [--out hip|svcii|parquet] [--segments N]`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources.spec import make_graph, names


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vertexloom", description=__doc__, epilog=f"Formats: {', '.join(names())}; lmlmbtn, lmlmotn, power, lognorm, norm, erdos.")
    parser.add_argument("format")
    parser.add_argument("spec", help="values of the format, parted by colons")
    parser.add_argument("path", help="a folder of any scheme that Spark and pyarrow know")
    parser.add_argument("--out", choices=("hip", "svcii", "parquet"), default="hip")
    parser.add_argument("--segments", type=int, default=4)
    parser.add_argument("-v", "--verbose", action="store_true")
    got = parser.parse_args(arguments)
    graph = make_graph(spark or SparkSession.builder.getOrCreate(), got.format, got.spec, got.path, got.out, got.segments)
    if got.verbose:
        graph.info().show()


if __name__ == "__main__":
    main()
