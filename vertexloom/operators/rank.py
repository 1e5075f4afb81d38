"""PageRank with a fixed number of rounds or a stop rule.

Edges with a null end and null vertices take no part; loops and parallel edges count as edges. An empty
graph has no ranks. Further columns are left aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import dropped, fresh, stored_at
from .iterate import Near, counted, parts_of, placed

DAMPING = 0.85
# Rounds in one job.
ROUNDS = 4


def shares(graph: Graph) -> DataFrame:
    """(src, dst, share): a vertex's rank goes in equal shares along its edges, parallel ones included.

    Parallel edges are one row, so hot pairs don't grow the rounds.
    """
    edges = graph.edges.filter("src is not null and dst is not null")
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    return pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))


def pass_on(ranks: DataFrame, near: Near, base: float, columns: tuple[str, ...] = ("rank",)) -> DataFrame:
    """ranks with one round more: (id, *columns, new), where the last of columns is sent.

    The partial sums of each receiver are combined before the shuffle; vertices without mail get the base.
    """
    sums = near.follow(ranks.select("id", F.col(columns[-1]).alias("__sent"))).groupBy(F.col("dst").alias("__to")).agg(F.sum(F.col("__sent") * F.col("share")).alias("got"))
    return ranks.join(sums, F.col("id") == F.col("__to"), "left").select("id", *columns, (F.lit(base) + F.lit(DAMPING) * F.coalesce("got", F.lit(0.0))).alias("new"))


def hashed(vertices: DataFrame) -> DataFrame:
    """The vertices, hashed by id and never null, so that rounds on end need no shuffle of the ranks."""
    return vertices.filter("id is not null").select(F.coalesce("id", F.lit(-1)).alias("id")).repartition(parts_of(vertices.sparkSession), "id")


def pagerank(graph: Graph, steps: int = 30, store_every: int = ROUNDS) -> DataFrame:
    """(id, rank): starts at 1, `0.15 + 0.85 * sum`; the mass of vertices without edges is lost."""
    ranks = hashed(graph.vertices).withColumn("rank", F.lit(1.0))
    paths: list[str] = []
    with placed(shares(graph)) as near:
        for number in range(1, steps + 1):
            ranks = pass_on(ranks, near, 1 - DAMPING).select("id", F.col("new").alias("rank"))
            if number % store_every == 0 or number == steps:
                paths.append(fresh(graph.spark, "ranks"))
                ranks = stored_at(ranks, paths[-1])
                if len(paths) > 1:
                    dropped(graph.spark, paths.pop(0))
    return ranks


def pagerank_converged(graph: Graph, tolerance: float = 0.001, max_rounds: int = 1000, at_once: int = ROUNDS) -> tuple[DataFrame, int]:
    """(id, rank) that starts at 1/N with base 0.15/N, after the first round whose summed change is at most the tolerance; and the rounds.

    `at_once` rounds are one job, which sums up the change of each of them; the first that is small enough
    is taken, so the result is that of single rounds. No such round among max_rounds is an error.
    """
    spark = graph.spark
    vertices, n = counted(hashed(graph.vertices).select("id"), "vertices")
    if not n:
        return vertices.withColumn("rank", F.lit(0.0)), 0
    ranks, rounds, last = hashed(vertices).withColumn("r0", F.lit(1.0 / n)), 0, None
    with placed(shares(graph)) as near:
        while rounds < max_rounds:
            names, many = ["r0"], min(at_once, max_rounds - rounds)
            for k in range(1, many + 1):
                ranks = pass_on(ranks, near, (1 - DAMPING) / n, tuple(names)).withColumnRenamed("new", f"r{k}")
                names.append(f"r{k}")
            seen, path = Observation(), fresh(spark, "ranks")
            watched = ranks.observe(seen, *[F.sum(F.abs(F.col(f"r{k}") - F.col(f"r{k - 1}"))).alias(f"c{k}") for k in range(1, many + 1)])
            ranks = stored_at(watched, path)
            if last:
                dropped(spark, last)
            last, changes = path, seen.get
            for k in range(1, many + 1):
                if changes[f"c{k}"] <= tolerance:
                    return ranks.select("id", F.col(f"r{k}").alias("rank")), rounds + k
            rounds += many
            ranks = ranks.select(F.coalesce("id", F.lit(-1)).alias("id"), F.col(names[-1]).alias("r0")).repartition(parts_of(spark), "id")
    raise RuntimeError(f"ranks did not settle within {max_rounds} rounds")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """One row: least, largest and summed rank."""
    return ranks.agg(F.round(F.min("rank"), 6).alias("min_rank"), F.round(F.max("rank"), 6).alias("max_rank"), F.round(F.sum("rank"), 4).alias("sum_rank"))
