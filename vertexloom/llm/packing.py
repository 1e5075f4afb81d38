"""Packing into sequences by cutting stock with column generation.

A document's ids are cut at multiples of the sequence length: full pieces fill a sequence each, the
rest is one piece. Rests are counted by length class (the length rounded up to a multiple of `grain`).
The counts are the demand of a cutting-stock problem: a linear program over patterns (how many pieces
of each class go into a sequence), whose columns are priced by a knapsack dynamic program; patterns are
rounded down and what is left is packed by first-fit decreasing. The program works on at most
length / grain counts, however large the corpus. Pieces are ranked in their class, from counts for
each part and class, and a rank decides the sequence.

Where patterns would leave more than `slack` of all sequences unused (as when most rests are longer than
half a sequence), rests longer than half a sequence are cut once more, at the half, and packed anew.

Nulls: a null text is empty and still gets the end id; rows with a null doc_id are packed like others.
Repeated rows are documents of their own (a document's pieces are told apart by `part` and `row`).
Empty tables give an empty result. Further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, text_or_empty, tidied, tokenizer_path
from .tokens import encoder

LENGTH = 2048
GRAIN = 8
OFFSETS = 1 << 20
PIECES = "doc_id long, part long, row long, start long, length long, doc_tokens long, class int, place long, ids binary"


def knapsack(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Best pattern for prices of the classes 1..size (values[0] is class 1), any number of each, sizes in grains."""
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        gain = values[:c] + best[c - 1 :: -1][:c]
        k = int(np.argmax(gain))
        best[c], pick[c] = (gain[k], k + 1) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    pattern, c = np.zeros(size, np.int64), size
    while c > 0:
        if pick[c]:
            pattern[pick[c] - 1] += 1
            c -= int(pick[c])
        else:
            c -= 1
    return float(best[size]), pattern


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Product without a threaded library, whose idle threads would hold the driver's cores."""
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row pivots."""
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        k = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        hit = np.flatnonzero(work[:, i])
        hit = hit[hit != i]
        work[hit] -= work[hit, i, None] * work[i]
    return work[:, n:]


def solve(demand: np.ndarray, size: int, near: float = 0.002, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray, float]:
    """Linear program over patterns: (patterns as columns, how often each, its value). demand[i]: pieces of i+1 grains.

    It ends when the best column's gain bounds the value within `near` of the optimum. The demand is
    shaken a little against ties in the ratio test; the plan is made for the true demand.
    """
    used = np.flatnonzero(demand > 0)
    need = demand * (1 + 1e-3 * np.random.default_rng(7).random(len(demand)))
    if not len(used):
        return np.zeros((size, 0), np.int64), np.zeros(0), 0.0
    rows = len(used)
    basis = np.diag([float(size // (i + 1)) for i in used])
    at = {int(i): k for k, i in enumerate(used)}
    for i, k in at.items():  # start: a class with the one that fills its sequence up, the larger rest of the two alone
        j = at.get(size - i - 2, -1)
        if j > k:
            few, many = (k, j) if need[i] <= need[size - i - 2] else (j, k)
            basis[:, few] = 0
            basis[[few, many], few] = 1
    inverse = inverted(basis)
    x = times(inverse, need[used])
    for step in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        values = np.zeros(size)
        values[used] = prices
        gain, pattern = knapsack(np.maximum(values, 0), size)
        if gain <= 1 + near:
            break
        column = pattern[used].astype(float)
        way = times(inverse, column)
        ok = way > 1e-9
        ratio = np.where(ok, x / np.where(ok, way, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        pivot = inverse[leave] / way[leave]
        inverse = inverse - way[:, None] * pivot
        inverse[leave] = pivot
        x = np.maximum(x - way * ratio[leave], 0)
        x[leave] = ratio[leave]
        if step % 200 == 199:  # rounding errors
            inverse = inverted(basis)
            x = np.maximum(times(inverse, need[used]), 0)
    patterns = np.zeros((size, rows), np.int64)
    patterns[used] = np.rint(basis).astype(np.int64)
    return patterns, x, float(x.sum())


def plan(demand: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(how many sequences, pattern) so that the patterns hold the demand exactly."""
    patterns, x, _ = solve(demand, size)
    whole = np.floor(x + 1e-9).astype(np.int64)
    left = demand - (patterns * whole).sum(axis=1)
    for j in np.flatnonzero(left < 0):  # more room than pieces: give back whole sequences
        for k in np.flatnonzero(patterns[j] > 0):
            back = min(int(whole[k]), -(-int(-left[j]) // int(patterns[j, k]))) if left[j] < 0 else 0
            whole[k] -= back
            left += patterns[:, k] * back
    out = [(int(t), patterns[:, k]) for k, t in enumerate(whole) if t]
    bins: list[tuple[int, np.ndarray]] = []
    rest = left.copy()
    while rest.any():  # first-fit decreasing, many equal sequences at a time
        room, pattern = size, np.zeros(size, np.int64)
        for i in range(size - 1, -1, -1):
            if rest[i] and room > i:
                pattern[i] = min(int(rest[i]), room // (i + 1))
                room -= int(pattern[i]) * (i + 1)
        hit = pattern > 0
        many = int((rest[hit] // pattern[hit]).min())
        bins.append((many, pattern))
        rest = rest - pattern * many
    return out + bins


def pieces(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, end_id: int = 1, path: str | None = None) -> DataFrame:
    """PIECES, written to the shared folder: the cut documents with their ids and their rank within part and class."""
    path = path or tokenizer_path("word_bpe_49k.json")
    full = length // grain
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen, row = np.zeros(full + 1, np.int64), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                out: list[tuple] = []
                for d, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        got = min(length, n - start)
                        c = -(-got // grain)
                        out.append((d, part, row, start, got, n, c, int(seen[c]), ids[4 * start : 4 * (start + got)]))
                        seen[c] += 1
                    row += 1
                if out:
                    yield piece_batch(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return stored(rows.mapInArrow(tidied(cut), PIECES), "pieces")


def halved(cut: DataFrame, length: int, grain: int) -> DataFrame:
    """The pieces with those longer than half a sequence, but not full, cut at the half."""
    half = length // 2

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        seen = np.zeros(length // grain + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                out: list[tuple] = []
                for r in whole.slice(at, 512).to_pylist():
                    n = r["length"]
                    for lo, hi in [(0, half), (half, n)] if half < n < length else [(0, n)]:
                        c = -(-(hi - lo) // grain)
                        out.append((r["doc_id"], part, row, r["start"] + lo, hi - lo, r["doc_tokens"], c, int(seen[c]), r["ids"][4 * lo : 4 * hi]))
                        seen[c] += 1
                    row += 1
                yield piece_batch(out)

    return stored(cut.mapInArrow(tidied(split), PIECES), "pieces")


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def demand_of(cut: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Pieces of each class, and all their ids together."""
    demand, tokens = np.zeros(size, np.int64), 0
    for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("tokens")).collect():  # size rows at most
        demand[r["class"] - 1] = r["n"]
        tokens += r["tokens"]
    return demand, tokens


def pack(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, end_id: int = 1, path: str | None = None, slack: float = 0.02) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and ids (32-bit little-endian) of every piece.

    slack: where more than this share of all sequences would stay unused, rests over half a sequence are
    cut once more, at the half. No id is lost by that; a document so cut has one piece more.
    Nulls: a null text still has its end id; a null doc_id is kept. Rows with the same id or text are documents of their own.
    The ids move once, by sequence.
    """
    if length % grain:
        raise ValueError("grain must divide length")
    cut = pieces(docs, length, grain, end_id, path)
    spark, size = docs.sparkSession, length // grain
    demand, tokens = demand_of(cut, size)
    made = plan(demand, size)
    if tokens < (1 - slack) * length * sum(n for n, _ in made) - length:
        cut = halved(cut, length, grain)
        demand, _ = demand_of(cut, size)
        made = plan(demand, size)
    slots, first = [], 0  # ranks of a class from `lo` on go `each` to a sequence, from sequence `first` on
    taken = np.zeros(size, np.int64)
    for many, pattern in made:
        for i in np.flatnonzero(pattern).tolist():
            slots.append((i + 1, int(taken[i]), int(taken[i] + many * pattern[i]), int(pattern[i]), first))
            taken[i] += many * pattern[i]
        first += many
    # Ranks: pieces of earlier parts of the class, and the place in the own part.
    parts = cut.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(parts.select("class", "part", before.alias("before")), "offsets")
    if offsets.count() <= OFFSETS:  # so the ids are not shuffled for them
        offsets = F.broadcast(offsets)
    ranked = cut.join(offsets, ["class", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    # size patterns of the program with size classes each, and those of the rest, bound this table: for each class its slots in order of ranks
    table = F.broadcast(spark.createDataFrame(slots, "class int, lo long, hi long, each long, first long").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "each", "first"))).alias("slots")))
    slot = F.filter("slots", lambda s: (F.col("rank") >= s["lo"]) & (F.col("rank") < s["hi"]))[0]
    placed = ranked.join(table, "class").withColumn("slot", slot).withColumn("sequence_id", F.expr("slot.first + (rank - slot.lo) div slot.each"))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "row", "start").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "part", "row", "start", "length", "doc_tokens", "ids", "sequence_id").withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0))).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
