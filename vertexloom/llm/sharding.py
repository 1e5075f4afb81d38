"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The rows lie in P parts. The number of rows that go from each part to each cell of each shard is
drawn exactly (multivariate hypergeometric, so the law is that of a uniform permutation of all
rows), each part deals its rows out in a random order of its own, rows are exchanged by cell, and
each cell is permuted again. The counts of all cells are fixed beforehand, so shards differ by one
row at most.

The matrix is never held whole: column totals are split down a binary tree over the parts with a
generator seeded by the node, so a task finds its own row of the matrix with log2(P) draws. The
driver holds one number for each part.

Nulls: any column may be null; a row counts as a row. Empty tables give an empty result. Equal and
repeated rows are dealt out one by one like any others. Columns of the input that are named as
result columns (shard, slot) are replaced by the results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

CELL_ROWS = 512
MAX_CELLS = 1 << 16


def cell_sizes(rows: int, shards: int, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Sizes of all cells, shard by shard: shards differ by one row at most, and so do cells of a shard."""
    cells = max(1, min(-(-rows // (shards * cell_rows)), max_cells // shards or 1))
    out = []
    for s in range(shards):
        size = rows // shards + (s < rows % shards)
        out += [size // cells + (c < size % cells) for c in range(cells)]
    return np.array(out, dtype=np.int64)


def draw(good: int, bad: int, want: int, rng: np.random.Generator) -> int:
    """A hypergeometric number, of the same law at all sizes.

    Above the range of numpy's generator it is drawn by inversion over 12 deviations around the mode; what
    lies beyond has less than 2**-100 of the mass, far below what a draw of 53 bits can tell.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, want))
    lo, hi, n = max(0, want - bad), min(good, want), good + bad
    mode = min(hi, max(lo, int((want + 1) * (good + 1) / (n + 2))))
    reach = int(12 * (want * (good / n) * (bad / n) * ((n - want) / max(1, n - 1))) ** 0.5) + 12
    k = np.arange(max(lo, mode - reach), min(hi, mode + reach), dtype=np.float64)
    steps = np.log(good - k) + np.log(want - k) - np.log(k + 1) - np.log(bad - want + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return max(lo, mode - reach) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def split_columns(left_rows: int, columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """How many of each column fall among the first left_rows of sum(columns) shuffled rows."""
    out = np.zeros_like(columns)
    rest, want = int(columns.sum()), int(left_rows)
    for i, c in enumerate(columns.tolist()):
        if want <= 0:
            break
        rest -= c
        got = draw(c, rest, want, rng) if c and rest else min(c, want)
        out[i] = got
        want -= got
    return out


def matrix_row(part: int, sizes: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix, by descent through the tree of parts."""
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = split_columns(int(sizes[lo:mid].sum()), columns, rng)
        lo, hi, columns = (lo, mid, left) if part < mid else (mid, hi, columns - left)
    return columns


def shard_rows(df: DataFrame, shards: int, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with shard (int, 0 to shards-1) and slot (long, gapless from 0 in each shard), a uniform shuffle."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    df = df.drop("shard", "slot")
    kept = stored(df.withColumn("__vl_at", F.monotonically_increasing_id()), "shard")
    kept = kept.withColumn("__vl_part", F.shiftright("__vl_at", 33).cast("int")).withColumn("__vl_row", F.col("__vl_at").bitwiseAND((1 << 33) - 1))
    parts = {r[0]: r[1] for r in kept.groupBy("__vl_part").count().collect()}  # one number a part
    ids = np.array(sorted(parts), dtype=np.int64)
    sizes = np.array([parts[i] for i in ids.tolist()], dtype=np.int64)
    cells = cell_sizes(int(sizes.sum()), shards, cell_rows)
    starts = np.concatenate([np.cumsum(x) - x for x in cells.reshape(shards, -1)])
    per_shard = len(cells) // shards
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cells_of(part: pd.Series, row: pd.Series) -> pd.Series:
        cell = np.empty(len(part), dtype=np.int32)
        for p in part.unique().tolist():
            if p not in known:
                known.clear()
                at = int(np.searchsorted(ids, p))
                known[p] = np.random.default_rng([seed, 1, p]).permutation(int(sizes[at])), np.cumsum(matrix_row(at, sizes, cells, seed))
            order, ends = known[p]
            here = (part == p).to_numpy()
            cell[here] = np.searchsorted(ends, order[row.to_numpy()[here]], side="right")
        return pd.Series(cell)

    dealt = kept.withColumn("__vl_cell", F.pandas_udf(cells_of, "int")("__vl_part", "__vl_row"))
    begins = F.broadcast(df.sparkSession.createDataFrame([(i, i // per_shard, int(s)) for i, s in enumerate(starts.tolist())], "__vl_cell int, shard int, __vl_begin long"))  # MAX_CELLS rows at most
    order = F.xxhash64(F.lit(seed), "__vl_part", "__vl_row")
    slot = F.row_number().over(W.partitionBy("__vl_cell").orderBy(order, "__vl_part", "__vl_row")) - 1
    out = dealt.withColumn("__vl_slot", slot).join(begins, "__vl_cell")
    return out.select(*[out[c] for c in df.columns], "shard", (F.col("__vl_begin") + F.col("__vl_slot")).alias("slot"))

