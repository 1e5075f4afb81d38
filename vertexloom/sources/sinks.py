"""Text outputs: DOT, histograms, member listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.index import beside
from ..functions.scalar import size_colour
from ..graph import Graph
from ..operators.degrees import histogram_statistics


def dot_lines(graph: Graph, transposed: bool = False) -> DataFrame:
    """(line): an edge `a -> b;` a row; transposed edges are red and point back."""
    a, b = ("dst", "src") if transposed else ("src", "dst")
    tail = ' [color="red"];' if transposed else ";"
    return graph.edges.select(F.concat(F.lit("  "), F.col(a).cast("string"), F.lit(" -> "), F.col(b).cast("string"), F.lit(tail)).alias("line"))


def write_dot(graph: Graph, path: str) -> None:
    """A folder of text parts that make one DOT file in the order of their names."""
    spark = graph.spark
    head = spark.createDataFrame([("digraph g {",)], "line string").coalesce(1)
    tail = spark.createDataFrame([("}",)], "line string").coalesce(1)
    head.union(dot_lines(graph)).union(tail).write.text(path)


def quotient_dot_lines(sizes: DataFrame, edges: DataFrame, depths: DataFrame, deepest: int, most: int = 1000) -> DataFrame:
    """(line) of the quotient's components up to a depth from the leaves; at most `most` of them, the least deep first (a report)."""
    shown = sizes.join(depths, "comp").filter(F.col("depth") <= deepest).orderBy("depth", "comp").limit(most)
    largest = shown.agg(F.max("size").alias("largest"))
    nodes = beside(shown, largest).select(
        F.concat(F.lit("  "), F.col("comp").cast("string"), F.lit(' [label="'), F.col("size").cast("string"), F.lit('", fillcolor="'), size_colour(F.col("size"), F.col("largest")), F.lit('"];')).alias("line")
    )
    ends = shown.select("comp")
    lines = edges.join(ends.withColumnRenamed("comp", "src_comp"), "src_comp", "left_semi").join(ends.withColumnRenamed("comp", "dst_comp"), "dst_comp", "left_semi")
    return nodes.union(lines.select(F.concat(F.lit("  "), F.col("src_comp").cast("string"), F.lit(" -> "), F.col("dst_comp").cast("string"), F.lit(";")).alias("line")))


def histogram_lines(hist: DataFrame, value: str = "degree") -> DataFrame:
    """(line): statistics as comments, then `count value` rows in the order of values."""
    s = histogram_statistics(hist, value)
    names = [("min", "min_value"), ("max", "max_value"), ("avg", "mean_value"), ("stdev", "stdev"), ("unique", "distinct_values"), ("all", "n")]
    heads = s.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.concat(F.lit(f"# {n} "), F.col(c).cast("string")).alias("line")) for i, (n, c) in enumerate(names)])).alias("x")).select("x.at", "x.line")
    rows = hist.select((F.lit(10) + F.col(value)).alias("at"), F.concat_ws(" ", F.col("cnt").cast("string"), F.col(value).cast("string")).alias("line"))
    return heads.select(F.col("at").cast("long"), "line").union(rows.select(F.col("at").cast("long"), "line")).orderBy("at").select("line")


def write_members(members: DataFrame, path: str) -> None:
    """(comp, name) as text, a folder for each component."""
    members.select("comp", F.col("name").alias("value")).repartition("comp").write.partitionBy("comp").text(path)
