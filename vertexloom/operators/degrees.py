"""Degree histograms and their statistics. Edges with a null end count for the end they have; an empty graph has an empty histogram, whose statistics are nulls and zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def degree_histogram(graph: Graph, incoming: bool = False) -> DataFrame:
    """(degree, cnt) over all vertices, degree 0 included."""
    degrees = graph.in_degrees() if incoming else graph.out_degrees()
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("cnt"))


def histogram_of(values: DataFrame, value: str = "value", count: str | None = None) -> DataFrame:
    """(value, cnt) of a multiset; weighted rows add their count. Negative values or counts are an error."""
    rows = values.select(F.col(value).cast("long").alias("value"), (F.col(count) if count else F.lit(1)).cast("long").alias("cnt"))
    checked = rows.select(F.when((F.col("value") < 0) | (F.col("cnt") < 0), F.raise_error(F.lit("negative value or count"))).otherwise(F.col("value")).cast("long").alias("value"), "cnt")
    return checked.groupBy("value").agg(F.sum("cnt").alias("cnt"))


def merge_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("value").agg(F.sum("cnt").alias("cnt"))


def histogram_statistics(hist: DataFrame, value: str = "degree", compat: bool = False) -> DataFrame:
    """One row: all values, distinct values, least, largest, mean, sample deviation.

    compat: the deviation over distinct values, each once, divided by (all - 1) outside the root.
    """
    v, c = F.col(value).cast("double"), F.col("cnt")
    sums = hist.agg(
        F.sum(c).alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.sum(v * c).alias("s1"), F.sum(v * v * c).alias("s2"), F.sum(v).alias("u1"), F.sum(v * v).alias("u2"),
    )
    mean = F.col("s1") / F.col("n")
    if compat:
        spread = F.sqrt(F.greatest(F.col("u2") - 2 * mean * F.col("u1") + mean * mean * F.col("distinct_values"), F.lit(0.0))) / (F.col("n") - 1)
    else:
        spread = F.sqrt(F.greatest((F.col("s2") - mean * F.col("s1")) / (F.col("n") - 1), F.lit(0.0)))
    return sums.select("n", "distinct_values", "min_value", "max_value", F.round(mean, 6).alias("mean_value"), F.round(F.when(F.col("n") > 1, spread).otherwise(0.0), 6).alias("stdev"))
