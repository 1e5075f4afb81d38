"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is a minimum for each node (pre-aggregated before the shuffle) and an equi-join whose hot
keys are split at run time; the link table is written to the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import dropped, fresh, stored_at

MAX_ROUNDS = 60


def both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(links: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest of the node and its neighbours."""
    near = both_ways(links)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def watched(links: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    """The table written to a path, and sums that tell it from others: taken while it is written, without a job more."""
    seen = Observation()
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.col("b").cast("decimal(38,0)")).alias("b")]
    table = stored_at(links.observe(seen, *sums), path, "zstd")
    got = seen.get
    return table, (got.get("n", 0), got.get("h"), got.get("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has a link. links: (a long, b long).

    A link with a null end or to itself is none; repeated links are one. Without links the result is
    empty. Of the rounds' tables only the last is kept.
    """
    spark = links.sparkSession
    clean = links.filter("a is not null and b is not null and a <> b")
    path = fresh(spark, "links")
    now, last = watched(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    for _ in range(MAX_ROUNDS):
        if not last[0]:
            break
        new_path = fresh(spark, "links")
        now, new = watched(small_star(large_star(now)), new_path)
        dropped(spark, path)
        path = new_path
        if new == last:
            break
        last = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
