"""Directed triangles. Edges with a null end and loops make none; an empty graph has none. Further columns are left aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def triangle_counts(graph: Graph, compat: bool = False) -> DataFrame:
    """(id, n): directed 3-cycles of distinct vertices through each vertex, on distinct edges.

    Each cycle is found once, from its vertex of least degree (ties by id): an edge into it and an edge
    out of it, whose other ends both rank higher, make a path that the third edge closes. So a hub opens no
    path, and there are at most as many paths as edges times the root of their number. compat: for each edge
    into a vertex whose reverse exists, with multiplicity, the sender's in-degree.
    """
    if compat:
        e = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("n").alias("m"))
        degree = graph.edges.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("degree"))
        mutual = e.join(back, ["src", "dst"]).join(degree, "src")
        return mutual.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("n") * F.col("m") * F.col("degree")).alias("n"))
    e = graph.edges.filter("src <> dst").select("src", "dst").distinct()
    degree = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    a, b = degree.toDF("src", "ds"), degree.toDF("dst", "dd")
    ranked = e.join(a, "src").join(b, "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = ranked.filter(up).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    into = ranked.filter(~up).select(F.col("dst").alias("a"), F.col("src").alias("c"))
    closing = e.select(F.col("src").alias("b"), F.col("dst").alias("c"))
    cycles = out.join(into, "a").join(closing, ["b", "c"])
    return cycles.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def top_triangles(graph: Graph, top: int = 10, compat: bool = False) -> DataFrame:
    """The `top` vertices by count, ties by id; vertices without a triangle qualify with 0."""
    counts = graph.vertices.select("id").join(triangle_counts(graph, compat), "id", "left")
    return counts.select("id", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "id").limit(top)
