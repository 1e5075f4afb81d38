"""A directed multigraph as two DataFrames.

Parallel edges and loops are kept and count as edges. Edges with a null end belong to no vertex: degrees,
neighbours and algorithms leave them out; `info` counts them as edges. Further columns of edges are kept
by views, and left aside by algorithms.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.index import beside
from .storage import stored


@dataclass(frozen=True)
class Graph:
    """vertices (id long, ...) and edges (src long, dst long, ...). root: a vertex or None. spanned: the vertices are just the ends of edges. once: no two edges have the same ends."""

    vertices: DataFrame
    edges: DataFrame
    root: int | None = None
    spanned: bool = False
    once: bool = False

    @classmethod
    def of_edges(cls, edges: DataFrame, root: int | None = None, once: bool = False) -> Graph:
        """The graph whose vertices are the ends of its edges, found in one pass over them."""
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).filter("id is not null")
        return cls(ends.distinct(), edges, root, True, once)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def materialized(self) -> Graph:
        """The same graph, written once: for algorithms that read it in every round."""
        edges = stored(self.edges, "edges")
        if self.spanned:
            whole = Graph.of_edges(edges, self.root)
            return Graph(stored(whole.vertices, "vertices"), edges, self.root, True, self.once)
        return Graph(stored(self.vertices, "vertices"), edges, self.root, False, self.once)

    def transpose(self) -> Graph:
        others = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *others), self.root, self.spanned, self.once)

    def undirected(self) -> Graph:
        """Every edge in both directions."""
        return Graph(self.vertices, self.edges.select("src", "dst").union(self.transpose().edges.select("src", "dst")), self.root, self.spanned)

    def simple(self) -> Graph:
        """Without parallel edges."""
        return Graph(self.vertices, self.edges.select("src", "dst").distinct(), self.root, self.spanned)

    def out_degrees(self) -> DataFrame:
        """(id, degree) with multiplicity; vertices without edges have 0."""
        return self._degrees("src")

    def in_degrees(self) -> DataFrame:
        return self._degrees("dst")

    def _degrees(self, end: str) -> DataFrame:
        if self.spanned:  # one pass over the edges: an end counts, the other one only makes its vertex known
            other = "dst" if end == "src" else "src"
            ends = F.explode(F.array(F.struct(F.col(end).alias("id"), F.lit(1).alias("n")), F.struct(F.col(other).alias("id"), F.lit(0).alias("n"))))
            return self.edges.select(ends.alias("x")).select("x.*").filter("id is not null").groupBy("id").agg(F.sum("n").alias("degree"))
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def neighbors(self, vertex: int) -> DataFrame:
        """Targets of a vertex's edges, with multiplicity."""
        return self.edges.filter(F.col("src") == vertex).select(F.col("dst").alias("id"))

    def in_neighbors(self, vertex: int) -> DataFrame:
        return self.edges.filter(F.col("dst") == vertex).select(F.col("src").alias("id"))

    def vertex(self, vertex: int) -> DataFrame:
        return self.vertices.filter(F.col("id") == vertex)

    def adjacency(self) -> DataFrame:
        """(id, neighbors): the targets of each vertex as a sorted array."""
        return self.edges.filter("src is not null and dst is not null").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))

    def dump(self, most: int | None = None) -> DataFrame:
        """(id, targets, sources) of every vertex as sorted arrays, or of the `most` vertices with the least ids (a report)."""
        vertices = self.vertices.filter("id is not null").select("id")
        if most is not None:
            vertices = vertices.orderBy("id").limit(most)
        none = F.array().cast("array<bigint>")
        ahead = self.adjacency().select("id", F.col("neighbors").alias("targets"))
        back = self.transpose().adjacency().select("id", F.col("neighbors").alias("sources"))
        return vertices.join(ahead, "id", "left").join(back, "id", "left").select("id", F.coalesce("targets", none).alias("targets"), F.coalesce("sources", none).alias("sources"))

    def partition_sizes(self) -> DataFrame:
        """Vertices of each partition of the vertex table."""
        return self.vertices.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("vertices"))

    def info(self) -> DataFrame:
        """One row: vertices, edges, average degree (null without vertices), loops, and edges that repeat another."""
        edges = self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        totals = edges.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("edges"),
            F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("loops"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("parallel"),
        )
        n = self.vertices.agg(F.count(F.lit(1)).alias("vertices"))
        return beside(n, totals).select("vertices", "edges", F.round(F.try_divide("edges", "vertices"), 6).alias("avg_degree"), "loops", "parallel")

    @cached_property
    def size(self) -> int:
        return self.vertices.count()

    def first_vertex(self) -> int | None:
        """The root, or else the least id."""
        return self.root if self.root is not None else self.vertices.agg(F.min("id")).first()[0]

    def save(self, path: str) -> None:
        """Parquet: vertices, edges, and the root."""
        self.vertices.write.parquet(f"{path}/vertices")
        self.edges.write.parquet(f"{path}/edges")
        self.spark.createDataFrame([(self.root,)], "root long").write.parquet(f"{path}/root")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        root = spark.read.parquet(f"{path}/root").first()[0]
        return cls(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), root)
