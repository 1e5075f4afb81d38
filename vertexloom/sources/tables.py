"""Graphs in relational tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import with_row_number
from ..graph import Graph

SUPPLIER_BASE = 1_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def following(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of lines with following numbers, of lines (order, number, part) sorted by order and number. It holds a batch and the last two numbers' lines."""
    held = None
    for x in chain(batches, (None,)):
        rows = [y for y in (held, x) if y is not None and y.num_rows]
        if not rows:
            continue
        rows = pa.Table.from_batches(rows).combine_chunks()
        order, number = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        first = np.concatenate([[0], np.flatnonzero((np.diff(order) != 0) | (np.diff(number) != 0)) + 1])  # of each order and number
        size = np.diff(np.append(first, rows.num_rows))
        last = len(first) - (x is not None)  # the last number may go on
        a, b = first[: max(last - 1, 0)], first[1:last]
        met = np.flatnonzero((order[a] == order[b]) & (number[a] + 1 == number[b]))
        n, m = size[met], size[met + 1]
        pairs = n * m
        at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        wide = np.repeat(m, pairs)
        part = rows.column(2)
        yield pa.record_batch([part.take(pa.array(np.repeat(f, pairs) + k)).combine_chunks() for f, k in ((first[met], at // wide), (first[met + 1], at % wide))], names=["src", "dst"])
        held = rows.slice(first[max(last - 1, 0)]).to_batches()[0] if x is not None else None


def part_succession(spark: SparkSession, folder: str, once: bool = True) -> Graph:
    """Distinct pairs of parts on following lines of an order: lines move once, to their order's task. Not once: pairs come as often as they are met, for algorithms to which that is the same; it saves moving all of them."""
    lines = table(spark, folder, "lineitem").filter("l_orderkey is not null and l_linenumber is not null")
    lines = lines.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey").cast("long"))
    pairs = lines.repartition("l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber").mapInArrow(following, "src long, dst long")
    return Graph.of_edges(pairs.distinct() if once else pairs, 1, once)


def followers(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with the user of the next one in time, by a join of row numbers: no task sees all events."""
    rows = with_row_number(table(spark, folder, "events").select("ts", "event_id", F.col("user_id").alias("src")), "ts", "event_id")
    ahead = rows.select((F.col("row") - 1).alias("row"), F.col("src").alias("dst"))
    return rows.join(ahead, "row")


def user_succession(spark: SparkSession, folder: str) -> Graph:
    """A multigraph of users in the order of their events."""
    return Graph.of_edges(followers(spark, folder).select("src", "dst"))


def outer_succession(spark: SparkSession, folder: str) -> Graph:
    """A sparse graph of all users: distinct edges to the users who follow a user's first event and the last one."""
    rows = followers(spark, folder)
    ends = rows.groupBy("src").agg(F.min_by("dst", "row").alias("a"), F.max_by("dst", "row").alias("b"))
    return Graph.of_edges(ends.select("src", F.explode(F.array_distinct(F.array("a", "b"))).alias("dst")), once=True)


def customer_suppliers(spark: SparkSession, folder: str) -> Graph:
    """A bipartite graph: distinct customers to suppliers (numbered from 10**9 on)."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_suppkey") + SUPPLIER_BASE).alias("dst"))
    return Graph.of_edges(orders.join(lines, "l_orderkey").select("src", "dst").distinct(), once=True)


def nation_trade(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst, w): lines ordered from a nation's customers at a nation's suppliers."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    joined = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "o_custkey")
    return joined.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst): a page's url and the targets of its links, with multiplicity."""
    return table(spark, folder, "pages").select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("dst"))


def numbered(links: DataFrame) -> tuple[Graph, DataFrame]:
    """A graph over numbers for links between strings, and (id, name)."""
    ends = links.select(F.col("src").alias("name")).union(links.select("dst")).filter("name is not null").distinct()
    names = with_row_number(ends, "name", name="id")
    a, b = names.withColumnsRenamed({"name": "src", "id": "s"}), names.withColumnsRenamed({"name": "dst", "id": "d"})
    edges = links.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return Graph(names.select("id"), edges), names
