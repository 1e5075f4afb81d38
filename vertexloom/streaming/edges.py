"""Streams of edges: windowed degree counts with late data, and distances kept up to date as edges come.

Edges with a null end are left out by distances; windowed degrees count them under their source (a null
source is a row of its own), edges without a time are left out. Repeated edges count again in degrees, once in distances.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.iterate import Layers, placed
from ..operators.traversal import FEW, HOPS, reach
from ..storage import dropped


def windowed_degrees(edges: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, id, degree): out-degrees by window of an edge stream (src, time, ...); later edges than the watermark are left out."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    counted = edges.withWatermark(time, late).groupBy(window.alias("w"), F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return counted.select(F.col("w.start").alias("window_start"), "id", "degree")


def distinct_edges(edges: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each edge once while the watermark lasts."""
    return edges.withWatermark(time, late).dropDuplicatesWithinWatermark(["src", "dst"])


class DistanceKeeper:
    """A foreachBatch sink that keeps (id, dist) from a root for all edges so far, as Parquet generations under a path.

    A batch writes its own edges as they come (repeated ones are thrown out where edges are placed, so nothing moves
    before) and relaxes what they shorten: distances go down by rounds over the
    vertices that changed. Generation n is the distances after batch n; a generation counts once it is
    written whole. A batch starts from the latest one below it in the folder, so a new process goes on
    where another ended, and a repeated batch gives the same result. The last two generations are kept.
    """

    def __init__(self, root: int, path: str):
        self.root, self.path = root, path.rstrip("/")

    def generations(self, spark: SparkSession) -> list[int]:
        """Whole generations in the folder, ascending."""
        base = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dist")
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        found = (int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(base))
        return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dist/batch={n}/_SUCCESS")))

    def distances(self, spark: SparkSession, generation: int | None = None) -> DataFrame:
        """(id, dist) of a generation, or of the latest."""
        known = self.generations(spark)
        if not known:
            return spark.createDataFrame([(self.root, 0)], "id long, dist int")
        return spark.read.schema("id long, dist int").parquet(f"{self.path}/dist/batch={known[-1] if generation is None else generation}")

    def edges(self, spark: SparkSession, upto: int) -> DataFrame:
        """(src, dst) of all batches up to one."""
        return spark.read.schema("src long, dst long, batch long").option("basePath", f"{self.path}/edges").parquet(f"{self.path}/edges").filter(F.col("batch") <= upto).select("src", "dst")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [n for n in self.generations(spark) if n < batch_id]
        dist = self.distances(spark, known[-1]) if known else spark.createDataFrame([(self.root, 0)], "id long, dist int")
        new = batch.filter("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        new.write.mode("overwrite").parquet(f"{self.path}/edges/batch={batch_id}")
        new = spark.read.schema("src long, dst long").parquet(f"{self.path}/edges/batch={batch_id}")
        improve(dist, self.edges(spark, batch_id), new).write.mode("overwrite").parquet(f"{self.path}/dist/batch={batch_id}")
        for old in known[:-1]:
            dropped(spark, f"{self.path}/dist/batch={old}")


def improve(dist: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """(id, dist) after new edges: a frontier of shortened vertices is passed on until none is left, a small one HOPS edges a round. Rounds write only what changed."""
    spark = dist.sparkSession
    with placed(edges) as near, Layers(spark, "improve", {"dist": F.min}) as state:
        state.add(dist.select("id", "dist"))

        def better(offers: DataFrame) -> DataFrame:
            least = offers.groupBy("id").agg(F.min("dist").alias("dist"))
            now = state.whole().select("id", F.col("dist").alias("old"))
            return least.join(now, "id", "left").filter("old is null or dist < old").select("id", "dist")

        first = state.whole().join(new, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + 1).alias("dist"))
        frontier, rows = state.add(better(first))
        while rows:
            layer, offers = frontier, None
            for _ in range(HOPS if rows <= FEW else 1):
                layer = near.follow(layer).groupBy(F.col("dst").alias("id")).agg((F.min("dist") + 1).alias("dist"))
                offers = layer if offers is None else offers.union(layer)
            frontier, rows = state.add(better(offers))
        return state.result()


def distances(graph: Graph, root: int) -> DataFrame:
    """(id, dist) of the reached vertices in one go, for comparison."""
    return reach(graph.edges, graph.spark.createDataFrame([(root,)], "id long"))
