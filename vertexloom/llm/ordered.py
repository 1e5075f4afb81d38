"""Documents in ascending doc_id by partition, each partition with a look at the first document of the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

NULL_KEY = -(1 << 63)
RANGE_ROWS = 50_000


def with_lookahead(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text, look): partition i holds a range of ascending keys, then (look) the first document behind it.

    Behind the last document comes the first of all. Ranges come from approximate quantiles of doc_id;
    the driver holds a boundary and the smallest id of each range. There are as many ranges as shuffle
    partitions, and one for every RANGE_ROWS documents at least. A null doc_id sorts first, a null text is
    empty, rows with one id follow one another in the order of a hash of their texts. An empty table gives an empty one.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
    )
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = rows.agg(F.percentile_approx("key", shares, 100 * parts)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))
    bucket = F.pandas_udf(lambda k: pd.Series(np.searchsorted(bounds, k, side="right")), "int")
    least = {r[0]: r[1] for r in rows.select(bucket("key").alias("b"), "key").groupBy("b").agg(F.min("key")).collect()}  # a row a range
    order = sorted(least)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def places(key: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, key, side="right").tolist()
        return pd.Series([[2 * b, 2 * before[b] + 1] if least[b] == k else [2 * b] for b, k in zip(at, key.tolist(), strict=True)])

    dealt = rows.select("*", F.explode(F.pandas_udf(places, "array<int>")("key")).alias("place"))
    dealt = dealt.select("key", "doc_id", "text", F.shiftright("place", 1).alias("part"), (F.col("place") % 2 == 1).alias("look"), F.xxhash64("text").alias("tie"))
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("look", "key", "tie").select("key", "doc_id", "text", "look")
