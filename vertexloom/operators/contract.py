"""Contraction of a graph's edges before components are looked for: chains and ranges of ids.

A chain is a run of vertices with one edge in and one edge out. The vertices at its ends decide on it: it
lies in their component if that is one, else its vertices are alone. Chains are followed by doubling, so
a chain of n vertices takes log n rounds where reach or labels would take n. A ring of such vertices is a
component of its own.

A range of ids whose edges are at most `block` rows is one task: the components of the edges within it
are parts of the whole graph's components, and each becomes one vertex (its least id). So paths that stay within
ranges of ids take no rounds at all. The bound is one of rows in a task, whatever the graph's size.

Nothing is left out by either: `expand` brings the result over the smaller graph back to all vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .iterate import counted, moved, parts_of

BLOCK = 100_000
# Ranges of one pass; the driver holds a number for each.
RANGES = 4096
# Contraction goes on while it takes away one edge in so many.
WORTH = 10


def followed(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, end, last) of chain vertices: the first vertex that is none and the last one that is; (id, comp) of rings.

    links: (id, next, open) of chain vertices, open where next is one as well. A round doubles how far a vertex
    sees, so a round that ends none leaves rings only.
    """
    state, left = counted(links.select("id", F.col("next").alias("end"), F.col("id").alias("last"), F.col("id").alias("least"), "open"), "chains", "open")

    def doubled(rows: DataFrame) -> DataFrame:
        far = rows.select(F.col("id").alias("end"), F.col("end").alias("e"), F.col("last").alias("l"), F.col("least").alias("m"), F.col("open").alias("o"))
        near = rows.filter("open").join(moved(far), "end")
        return near.select("id", F.col("e").alias("end"), F.col("l").alias("last"), F.least("least", "m").alias("least"), F.col("o").alias("open"), (F.col("m") < F.col("least")).alias("lower"))

    before = left + 1
    while left and left < before:
        before = left
        state, left = counted(state.filter("not open").unionByName(doubled(state).drop("lower")), "chains", "open")
    if not left:
        return state.select("id", "end", "last"), None
    rings, lower = state.filter("open"), left
    while lower:
        rings, lower = counted(doubled(rings), "rings", "lower")
        rings = rings.drop("lower")
    return state.filter("not open").select("id", "end", "last"), rings.select("id", F.col("least").alias("comp"))


def range_bounds(edges: DataFrame, rows: int, block: int) -> list[int]:
    """Ids between which lie at most about `block` edges (src, ...) each, ascending; at most RANGES - 1."""
    pieces = min(RANGES, -(-rows // block))
    if pieces < 2:
        return []
    bounds = edges.agg(F.percentile_approx("src", [k / pieces for k in range(1, pieces)], max(1000, 8 * pieces)).alias("b")).first()[0]
    return sorted(set(bounds))


def in_ranges(edges: DataFrame, bounds: list[int], parts: int, task: Callable[[Iterator[list[list]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """task over the columns of edges (src, ...), a list of lists for each range of src."""
    names = edges.columns

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            at = np.searchsorted(bounds, x.column(0).to_numpy(), "right") if bounds else np.zeros(x.num_rows, np.int64)
            yield pa.record_batch([pa.array(at.astype(np.int64)), *x.columns], names=["at", *names])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
        now, columns = None, [[] for _ in names]
        for x in batches:
            at = x.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if at[i] != now:
                    if columns[0]:
                        yield columns
                    now, columns = at[i], [[] for _ in names]
                for k, c in enumerate(columns, 1):
                    c += x.column(k).slice(i, j - i).to_pylist()
        if columns[0]:
            yield columns

    rows = edges.mapInArrow(dealt, f"at long, {', '.join(f'{n} long' for n in names)}").repartition(parts, "at").sortWithinPartitions("at")
    return rows.mapInArrow(lambda batches: task(pieces(batches)), schema)


def passing(edges: DataFrame) -> DataFrame:
    """(id) with one edge in and one out."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 and i = 1").select("id")


def slender(edges: DataFrame, rows: int) -> bool:
    """Whether sources have less than 4/3 edges in the mean, so that most vertices may lie in chains."""
    return 3 * rows < 4 * edges.agg(F.approx_count_distinct("src")).first()[0]


class Chains:
    """Distinct edges without loops, each chain replaced by one edge between the vertices at its ends."""

    def __init__(self, edges: DataFrame, passes: DataFrame):
        links = edges.join(moved(passes.withColumnRenamed("id", "src")), "src").join(moved(passes.select(F.col("id").alias("dst"), F.lit(True).alias("open"))), "dst", "left")
        self.chains, self.rings = followed(links.select(F.col("src").alias("id"), F.col("dst").alias("next"), F.coalesce("open", F.lit(False)).alias("open")))
        kept = edges.join(moved(passes.withColumnRenamed("id", "src")), "src", "left_anti").join(moved(self.chains.withColumnRenamed("id", "dst")), "dst", "left")
        kept = stored(kept.select("src", F.coalesce("end", "dst").alias("dst"), F.col("last").alias("chain")), "kept")
        self.heads = kept.filter("chain is not null")
        self.passes = passes
        self.edges, self.rows = counted(kept.filter("src <> dst").select("src", "dst").repartition(parts_of(edges.sparkSession), "src", "dst").distinct(), "edges")

    def vertices(self, whole: DataFrame) -> DataFrame:
        return whole.join(moved(self.passes), "id", "left_anti")

    def reached(self, found: DataFrame) -> DataFrame:
        """(id) reached, from what is (id) of those left, where no source lies in a chain or ring."""
        entered = self.heads.join(moved(found.withColumnRenamed("id", "src")), "src", "left_semi").select(F.col("chain").alias("last")).distinct()
        return found.union(self.chains.join(moved(entered), "last", "left_semi").select("id"))

    def expand(self, found: DataFrame, alone: bool) -> DataFrame:
        how = "left" if alone else "inner"
        a, b = found.select(F.col("id").alias("src"), F.col("comp").alias("a")), found.select(F.col("id").alias("dst"), F.col("comp").alias("b"))
        heads = self.heads.join(moved(a), "src", how).join(moved(b), "dst", how)
        inside = stored(heads.filter("coalesce(a, src) = coalesce(b, dst)").select("src", "a", "chain"), "inside")
        whole = found.select("id", "comp").union(self.chains.join(moved(inside.select(F.col("chain").alias("last"), F.coalesce("a", "src").alias("comp"))), "last").select("id", "comp"))
        if alone:  # a vertex that had no edge left but leads back to itself by chains
            whole = whole.union(inside.filter("a is null").select(F.col("src").alias("id"), F.col("src").alias("comp")).distinct())
        return whole if self.rings is None else whole.union(self.rings)


def least_rows(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, in order."""
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    new = np.ones(len(src), bool)
    new[1:] = (np.diff(src) != 0) | (np.diff(dst) != 0)
    return src[new], dst[new]


class Pairs:
    """Pairs taken in by pieces; above `most` rows repeated ones are thrown out, so memory grows with the distinct ones alone."""

    def __init__(self, most: int):
        self.most, self.limit, self.rows = most, most, 0
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.pieces.append((src, dst))
        self.rows += len(src)
        if self.rows > self.limit:
            self.pieces = [self.all()]
            self.rows = len(self.pieces[0][0])
            self.limit = max(self.most, 2 * self.rows)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return least_rows(*(np.concatenate([x[k] for x in self.pieces]) for k in (0, 1)))


class Ranges:
    """Edges without loops made distinct, the components within ranges of ids made one vertex each. once: edges are distinct already.

    A range's task takes the edges out of its ids. Those within it are solved; the others follow and leave with
    their source's new name, so what is shuffled after that is few where components are large.
    """

    def __init__(self, edges: DataFrame, rows: int, block: int, solve: Callable[[list[int], list[int]], list[tuple[int, int]]], once: bool = True):
        bounds = range_bounds(edges, rows, block)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                a, b = x.column(0).to_numpy(), x.column(1).to_numpy()
                at = np.searchsorted(bounds, a, "right") if bounds else np.zeros(len(a), np.int64)
                out = at != np.searchsorted(bounds, b, "right") if bounds else np.zeros(len(a), bool)
                yield pa.record_batch([pa.array(2 * at.astype(np.int64) + out), x.column(0), x.column(1)], names=["key", "src", "dst"])

        def solved(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            out = solve(src.tolist(), dst.tolist())
            joined = {c for i, c in out if i != c}
            out = sorted(x for x in out if x[1] in joined)
            return np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)

        def rows_of(a: np.ndarray, b: np.ndarray, place: bool) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(np.full(len(a), place))], names=["a", "b", "place"])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, inner, leaving = None, Pairs(2 * block), Pairs(2 * block)
            places: tuple[np.ndarray, np.ndarray] | None = None

            def renamed(ids: np.ndarray) -> np.ndarray:
                known, to = places
                if not len(known):
                    return ids
                k = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                return np.where(known[k] == ids, to[k], ids)

            def settle() -> Iterator[pa.RecordBatch]:  # the range's own edges are all there
                nonlocal places
                src, dst = inner.all()
                places = solved(src, dst)
                yield rows_of(*places, True)
                src, dst = renamed(src), renamed(dst)
                yield rows_of(*least_rows(src[src != dst], dst[src != dst]), False)

            for x in batches:
                key = x.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    at, out = divmod(int(key[i]), 2)
                    if at != now:
                        if now is not None:
                            if places is None:
                                yield from settle()
                            yield rows_of(*leaving.all(), False)
                        now, inner, leaving, places = at, Pairs(2 * block), Pairs(2 * block), None
                    src, dst = x.column(1).slice(i, j - i).to_numpy(), x.column(2).slice(i, j - i).to_numpy()
                    if not out:
                        inner.add(src, dst)
                        continue
                    if places is None:
                        yield from settle()
                    if leaving.rows > block:
                        yield rows_of(*leaving.all(), False)
                        leaving = Pairs(2 * block)
                    leaving.add(renamed(src), dst)
            if now is not None:
                if places is None:
                    yield from settle()
                yield rows_of(*leaving.all(), False)

        parts = parts_of(edges.sparkSession)
        ranged = edges.select("src", "dst").mapInArrow(dealt, "key long, src long, dst long").repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key")
        table, self.found = counted(ranged.mapInArrow(task, "a long, b long, place boolean"), "ranges", "place")
        self.places = table.filter("place").select(F.col("a").alias("id"), F.col("b").alias("to"))
        self.edges, self.rows = edges, rows
        if self.found or not once:
            new = table.filter("not place").select(F.col("a").alias("src"), F.col("b").alias("dst"))
            if self.found:
                new = new.join(moved(self.places.select(F.col("id").alias("dst"), "to")), "dst", "left").select("src", F.coalesce("to", "dst").alias("dst"))
            self.edges, self.rows = counted(new.filter("src <> dst").repartition(parts, "src", "dst").distinct(), "edges")

    def vertices(self, whole: DataFrame) -> DataFrame:
        return whole.join(moved(self.places.filter("id <> to").select("id")), "id", "left_anti")

    def reached(self, found: DataFrame) -> DataFrame:
        """(id) reached, from what is (id) of those left."""
        return self.expand(found.withColumn("comp", F.lit(0)), alone=False).select("id")

    def expand(self, found: DataFrame, alone: bool) -> DataFrame:
        theirs = found.select(F.col("id").alias("to"), "comp")
        own = self.places.join(moved(theirs), "to", "left" if alone else "inner").select("id", F.coalesce("comp", "to").alias("comp"))
        return own.union(found.select("id", "comp").join(moved(self.places.select("id")), "id", "left_anti"))


class Contraction:
    """edges (without loops, without null), made fewer while they are more than `few`: chains, and ranges where they are more than `block`. trim: what else takes away edges on no cycle, where an id that is not listed is alone. once: edges are distinct; if not, they are more than `few` and `block`.

    Where most vertices pass one edge on (`slender`), chains go first: a chain over many ranges would take trimming a round for each.
    """

    def __init__(self, edges: DataFrame, rows: int, solve: Callable[[list[int], list[int]], list[tuple[int, int]]], few: int, block: int = BLOCK, trim: Callable[..., tuple[DataFrame, int]] | None = None, once: bool = True):
        self.levels: list[Chains | Ranges] = []
        self.edges, self.rows = edges, rows
        while self.rows > few:
            before, late = self.rows, not once
            if once:
                self._slender(block)
            if self.rows > block:
                self._add(Ranges(self.edges, self.rows, block, solve, once))
                once = True
            if late:
                self._slender(block)
            if self.rows > few and trim is not None:
                self.edges, self.rows = trim(self.edges, self.rows, block=block)
            if self.rows > few:
                passes, many = counted(passing(self.edges), "passes")
                if many * WORTH >= self.rows:
                    self._add(Chains(self.edges, passes))
            if (before - self.rows) * WORTH < before:
                break

    def _slender(self, block: int) -> None:
        if self.rows > block and slender(self.edges, self.rows):
            passes, many = counted(passing(self.edges), "passes")
            if many * 2 >= self.rows:
                self._add(Chains(self.edges, passes))

    def _add(self, level: Chains | Ranges) -> None:
        self.levels.append(level)
        self.edges, self.rows = level.edges, level.rows

    def vertices(self, whole: DataFrame) -> DataFrame:
        """(id) of those that are left of (id)."""
        for x in self.levels:
            whole = x.vertices(whole)
        return whole

    def expand(self, found: DataFrame, alone: bool) -> DataFrame:
        """(id, comp) of all vertices from those left. alone: an id not listed is a component of its own; else it is in none that counts."""
        for x in reversed(self.levels):
            found = stored(x.expand(found, alone), "expanded")
        return found
