"""Global reductions over vertex tables: one partial aggregate for each task, one row in the end.

Nulls are left out by sums, extents and flags, as SQL aggregates do; of no rows, sums of counters are 0 and extents null.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extent(df: DataFrame, value: str) -> DataFrame:
    """One row: least, largest, sum and mean of a column."""
    return df.agg(F.min(value).alias("least"), F.max(value).alias("largest"), F.sum(value).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def flags(df: DataFrame, condition: Column) -> DataFrame:
    """One row: whether a condition holds anywhere, and everywhere. Of no rows: nowhere, and everywhere."""
    return df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("anywhere"), F.coalesce(F.bool_and(condition), F.lit(True)).alias("everywhere"))


def vector_sum(df: DataFrame, *columns: str) -> DataFrame:
    """One row: sums of several counters in one pass."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def pivot(df: DataFrame, condition: Column) -> DataFrame:
    """One row: the least id that meets a condition, null if none does; the same whatever the partitions."""
    return df.agg(F.min(F.when(condition, F.col("id"))).alias("pivot"))


def reduce_custom(df: DataFrame, zero: Any, add: Callable[[Any, dict], Any], merge: Callable[[Any, Any], Any], fan: int = 64) -> Any:
    """A reduction over payloads of any type: rows are added to a payload in each task, payloads are merged in a tree.

    merge has to be associative and commutative, with zero as its neutral payload. Tasks pass on one
    payload each; `fan` of them are merged by a task, until the last ones come to the driver. Payloads
    are pickled; their size does not hang on the number of rows unless add makes it so.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = zero
        for b in batches:
            for row in b.to_pylist():
                got = add(got, row)
        yield pa.record_batch([pa.array([pickle.dumps(got)], pa.binary())], names=["payload"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = zero
        for b in batches:
            for x in b.column(0).to_pylist():
                got = merge(got, pickle.loads(x))
        yield pa.record_batch([pa.array([pickle.dumps(got)], pa.binary())], names=["payload"])

    parts = df.rdd.getNumPartitions()
    payloads = df.mapInArrow(partial, "payload binary")
    while parts > fan:
        parts = -(-parts // fan)
        payloads = payloads.repartition(parts).mapInArrow(join, "payload binary")
    whole = zero
    for r in payloads.collect():  # fan payloads at most
        whole = merge(whole, pickle.loads(bytes(r.payload)))
    return whole


def union_of(*sets: DataFrame) -> DataFrame:
    """(id): the union of sets of ids."""
    out = sets[0].select("id")
    for s in sets[1:]:
        out = out.union(s.select("id"))
    return out.distinct()


def partition_balance(df: DataFrame) -> DataFrame:
    """One row: partitions with rows, and mean and deviation of their numbers of rows."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("partitions"), F.round(F.avg("n"), 6).alias("mean_rows"), F.round(F.coalesce(F.stddev("n"), F.lit(0.0)), 6).alias("stdev_rows"))
