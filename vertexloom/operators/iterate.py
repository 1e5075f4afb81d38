"""Driver loops over tables: rounds, stop rules, co-located edges, and states that grow by layers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, fresh, stored, stored_at

# A source with more edges than this, and than an even share, is dealt out over several slots.
HEAVY = 1 << 18

# Rounds of all loops of this driver: (loop, round, rows written, seconds), the latest last.
LOG: list[tuple[str, int, int, float]] = []
LOG_ROWS = 10_000


def logged(loop: str, number: int, rows: int, seconds: float) -> None:
    LOG.append((loop, number, rows, round(seconds, 3)))
    del LOG[:-LOG_ROWS]


def statistics(spark: SparkSession) -> DataFrame:
    """(loop, rounds, rows, seconds): what the loops of this driver did, out of its last LOG_ROWS rounds."""
    rounds = spark.createDataFrame(LOG, "loop string, round int, rows long, seconds double")
    return rounds.groupBy("loop").agg(F.count(F.lit(1)).alias("rounds"), F.sum("rows").alias("rows"), F.round(F.sum("seconds"), 3).alias("seconds"))


def counted(df: DataFrame, tag: str = "table", where: str = "true") -> tuple[DataFrame, int]:
    """The stored table, and how many of its rows meet the condition: counted while they are written, without a job more."""
    seen = Observation()
    table = stored(df.observe(seen, F.count(F.when(F.expr(where), 1)).alias("n")), tag)
    return table, seen.get.get("n", 0)


def moved(rows: DataFrame) -> DataFrame:
    """rows to be joined where they are moved and sorted, whatever their size: none of them goes through the driver."""
    return rows.hint("merge")


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Near:
    """Edges hashed by their source and kept for all rounds of a loop, so that a round moves the frontier and never the edges.

    A heavy source's edges lie in several slots by their target; what is sent to it is copied to each of these.
    """

    def __init__(self, edges: DataFrame, heavy: int = HEAVY):
        spark, self.columns = edges.sparkSession, edges.columns
        whole = edges.filter("src is not null and dst is not null").select(*[F.coalesce(c, F.lit(-1)).alias(c) if c in ("src", "dst") else F.col(c) for c in edges.columns])
        parts = parts_of(spark)
        many = whole.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy)
        found = many.select("src", F.ceil(F.col("n") / heavy).cast("int").alias("slots")).orderBy(F.desc("slots"), "src").limit(4 * parts).collect()  # a bounded number of rows
        self.heavy = spark.createDataFrame([tuple(r) for r in found], "src long, slots int") if found else None
        if self.heavy is not None:
            whole = whole.join(F.broadcast(self.heavy), "src", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("slots")), F.lit(0)).cast("int")).drop("slots")
            self.kept = whole.repartition(parts, "src", "slot").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.kept = whole.repartition(parts, "src").distinct().persist(StorageLevel.MEMORY_AND_DISK)

    def follow(self, rows: DataFrame) -> DataFrame:
        """rows (id, ...) with the edges out of id."""
        if self.heavy is None:
            return rows.join(self.kept, F.col("id") == F.col("src"))
        slots = rows.join(F.broadcast(self.heavy.withColumnRenamed("src", "id")), "id", "left")
        slots = slots.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        return slots.join(self.kept, (F.col("id") == F.col("src")) & (F.col("__slot") == F.col("slot"))).drop("__slot", "slot")


@contextmanager
def placed(edges: DataFrame, heavy: int = HEAVY) -> Iterator[Near]:
    """The distinct rows of edges (src, dst, ...) as Near. Edges with a null end are left out."""
    near = Near(edges, heavy)
    try:
        yield near
    finally:
        near.kept.unpersist()


class Layers:
    """A table (id, ...) that grows by rounds, hashed by id.

    Each layer is written to the shared folder and kept hashed in the executors' memory: rounds join all
    layers without moving them, and what a lost executor held is read again from its files. `best` says
    how values of the same id in several layers go together (none: an id is in one layer only). Above
    MOST layers all but the last become one.
    """

    MOST = 16

    def __init__(self, spark: SparkSession, tag: str, best: dict[str, Callable[[str], Column]] | None = None):
        self.spark, self.tag, self.best, self.parts = spark, tag, best or {}, parts_of(spark)
        self.layers: list[DataFrame] = []
        self.files: list[tuple[str, DataFrame]] = []
        self.number, self.done = 0, False

    def __enter__(self) -> Layers:
        return self

    def __exit__(self, *_) -> None:
        for x in self.layers:
            x.unpersist()

    def _kept(self, path: str, table: DataFrame) -> DataFrame:
        hashed = table.select(*[F.coalesce(c, F.lit(-1)).alias(c) if c == "id" else F.col(c) for c in table.columns])  # never null, so joins need no filter on it
        layer = hashed.repartition(self.parts, "id").persist(StorageLevel.MEMORY_AND_DISK)
        self.layers.append(layer)
        self.files.append((path, table))
        return layer

    def add(self, rows: DataFrame, where: str = "true") -> tuple[DataFrame, int]:
        """The new layer, and how many of its rows meet the condition. ids are not null."""
        began, path, seen = time.time(), fresh(self.spark, self.tag), Observation()
        table = stored_at(rows.observe(seen, F.count(F.when(F.expr(where), 1)).alias("n"), F.count(F.lit(1)).alias("all")), path)
        got = seen.get
        self.number += 1
        logged(self.tag, self.number, got.get("all", 0), time.time() - began)
        layer = self._kept(path, table)
        if len(self.layers) > self.MOST:
            self._merge()
        return layer, got.get("n", 0)

    def _union(self, tables: list[DataFrame]) -> DataFrame:
        whole = tables[0]
        for x in tables[1:]:
            whole = whole.union(x)
        return whole.groupBy("id").agg(*[f(c).alias(c) for c, f in self.best.items()]) if self.best and len(tables) > 1 else whole

    def _merge(self) -> None:
        path = fresh(self.spark, self.tag)
        table = stored_at(self._union(self.layers[:-1]), path)
        last, last_file, old = self.layers[-1], self.files[-1], self.files[:-1]
        for x in self.layers[:-1]:
            x.unpersist()
        self.layers, self.files = [], []
        self._kept(path, table)
        self.layers.append(last)
        self.files.append(last_file)
        for p, _ in old:
            dropped(self.spark, p)

    def whole(self) -> DataFrame:
        return self._union(self.layers)

    def result(self) -> DataFrame:
        """The whole table, from files; layers that others supersede are deleted."""
        if not self.best or len(self.files) == 1:
            return self._union([t for _, t in self.files])
        table = stored(self._union(self.layers), self.tag)
        for p, _ in self.files:
            dropped(self.spark, p)
        return table


class StopRequested(Exception):
    """Raised by a round to end the loop with its last table: the driver-side form of a broadcast notice."""


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], changed: Callable[[DataFrame, DataFrame], bool], max_rounds: int = 10_000, every: int = 1) -> tuple[DataFrame, int]:
    """Repeats step until changed says no; the table is written every `every` rounds, and the one before the last deleted. Returns it and the rounds."""
    spark, paths = state.sparkSession, []
    for number in range(1, max_rounds + 1):
        try:
            new = step(state, number)
        except StopRequested:
            return state, number - 1
        if number % every == 0:
            paths.append(fresh(spark, "round"))
            new = stored_at(new, paths[-1])
            if not changed(state, new):
                return new, number
            if len(paths) > 2:
                dropped(spark, paths.pop(0))
        state = new
    raise RuntimeError(f"no fixpoint within {max_rounds} rounds")
