"""Centre-of-mass layout. Edges with a null end move nothing; vertices without neighbours stay; null vertices are kept. Parallel edges pull as often, loops pull to the vertex itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def layout(graph: Graph, x: Column, y: Column, rounds: int = 2) -> DataFrame:
    """(id, x, y): each round moves a vertex half-way to the mean of its neighbours (in either direction, with multiplicity)."""
    near = graph.undirected().edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    state = graph.vertices.select("id", x.cast("double").alias("x"), y.cast("double").alias("y"))
    for _ in range(rounds):
        sent = state.join(near, F.col("id") == F.col("src")).groupBy("dst").agg(
            (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("my")
        )
        state = state.join(sent, F.col("id") == F.col("dst"), "left").select(
            "id", ((F.col("x") + F.coalesce("mx", "x")) / 2).alias("x"), ((F.col("y") + F.coalesce("my", "y")) / 2).alias("y")
        )
    return state
