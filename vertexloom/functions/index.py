"""Row numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def with_row_number(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """df with `name`: 0-based place in the order of the columns.

    Rows are range-partitioned and numbered within their partition; the sizes of earlier partitions,
    a row for each, are added.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("__part", before.alias("__before"))
    local = F.col("__at") - F.shiftleft("__part", 33)
    return ranged.join(F.broadcast(offsets), "__part").select(*df.columns, (F.col("__before") + local).alias(name))


def beside(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of one row."""
    return rows.withColumn("__one", F.lit(1)).join(one.withColumn("__one", F.lit(1)), "__one").drop("__one")
