"""Synthetic graphs as column expressions over ranges. Vertex numbers are the order of creation, from 0; the root is 0."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..graph import Graph
from ..operators.iterate import counted

MOST_DEGREE = 32767
COPIES = 4096
TRIES = 1024


class GraphSpecError(ValueError):
    """A generator's parameters make no graph."""


def need(ok: bool, what: str) -> None:
    if not ok:
        raise GraphSpecError(what)


def graph_of(spark: SparkSession, vertices: int, edges: DataFrame) -> Graph:
    return Graph(spark.range(vertices).select("id"), edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), 0)


def pairs(rows: DataFrame, src: Column, dst: Column) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"))


ID = F.col


def line(spark: SparkSession, n: int) -> Graph:
    need(n > 0, "a line has a vertex at least")
    return graph_of(spark, n, pairs(spark.range(n - 1), ID("id"), ID("id") + 1))


def biline(spark: SparkSession, n: int) -> Graph:
    return graph_of(spark, n, line(spark, n).undirected().edges)


def ring(spark: SparkSession, n: int) -> Graph:
    need(n > 0, "a ring has a vertex at least")
    return graph_of(spark, n, pairs(spark.range(n), ID("id"), (ID("id") + 1) % n))


def biring(spark: SparkSession, n: int) -> Graph:
    """Both directions; with one vertex two loops, with two each edge twice."""
    return graph_of(spark, n, ring(spark, n).edges.union(pairs(spark.range(n), ID("id"), (ID("id") + n - 1) % n)))


def clique(spark: SparkSession, n: int) -> Graph:
    """All ordered pairs, from one range of n(n-1) numbers."""
    need(n > 0, "a clique has a vertex at least")
    src = F.floor(ID("id") / max(1, n - 1)).cast("long")
    dst = ID("id") % max(1, n - 1)
    return graph_of(spark, n, pairs(spark.range(n * (n - 1)), src, dst + (dst >= src).cast("long")))


def tree_size(height: int, branch: int) -> int:
    return (branch ** (height + 1) - 1) // (branch - 1)


def tree_edges(spark: SparkSession, height: int, branch: int) -> DataFrame:
    """Parent to child in pre-order numbers.

    A vertex is a path from the root: level d has branch**d of them, and each step of the path adds one
    and the sizes of the subtrees left of it. The path is read off the number's digits.
    """
    need(height >= 0, "a tree's height is 0 at least")
    need(branch >= 2, "a tree's branching is 2 at least")
    out = spark.createDataFrame([], "src long, dst long")
    for depth in range(1, height + 1):
        number = F.lit(0).cast("long")
        parent = number
        for step in range(1, depth + 1):
            digit = F.floor(ID("id") / (branch ** (depth - step))).cast("long") % branch
            parent = number
            number = number + 1 + digit * tree_size(height - step, branch)
        out = out.union(pairs(spark.range(branch**depth), parent, number))
    return out


def tree(spark: SparkSession, height: int, branch: int = 2) -> Graph:
    edges = tree_edges(spark, height, branch)
    return graph_of(spark, tree_size(height, branch), edges)


def randomized_tree(spark: SparkSession, n: int, seed: int, levels: int = 8) -> Graph:
    """Two children who share the remaining vertices at random; numbers in pre-order.

    A vertex with `left` vertices below holds the numbers up to id + left, so a level is a projection of
    the one above. `levels` of them are one job; a share is a draw for (seed, id), whatever the partitions.
    """
    need(n > 0, "a tree has a vertex at least")
    frontier = spark.createDataFrame([(0, n - 1)], "id long, left long")
    out: list[DataFrame] = []
    share = F.round(scalar.uniform(seed, "id") * (F.col("left") - 2)).cast("long")
    first = F.struct((F.col("id") + 1).alias("id"), F.when(F.col("left") == 1, F.lit(0)).otherwise(share).cast("long").alias("left"))
    second = F.struct((F.col("id") + 2 + share).alias("id"), (F.col("left") - 2 - share).cast("long").alias("left"))
    while True:
        rows = frontier.select("id", "left", F.lit(0).cast("long").alias("src"), F.lit(0).alias("level"))
        whole = None
        for level in range(1, levels + 1):
            kids = F.when(F.col("left") == 1, F.array(first)).otherwise(F.array(first, second))
            rows = rows.filter("left > 0").select(F.col("id").alias("src"), F.explode(kids).alias("kid")).select("kid.id", "kid.left", "src", F.lit(level).alias("level"))
            whole = rows if whole is None else whole.union(rows)
        made, more = counted(whole, "tree", f"level = {levels} and left > 0")
        out.append(made.select("src", F.col("id").alias("dst")))
        if not more:
            break
        frontier = made.filter((F.col("level") == levels) & (F.col("left") > 0)).select("id", "left")
    edges = out[0]
    for x in out[1:]:
        edges = edges.union(x)
    return graph_of(spark, n, edges)


def lattice_edges(spark: SparkSession, rows: int, cols: int, loop_rows: bool, loop_cols: bool, rows_filled: int | None = None, cols_filled: int | None = None) -> DataFrame:
    """East edges in the first rows_filled rows, south edges in the first cols_filled columns; loops close rows and columns."""
    need(rows > 0 and cols > 0, "a lattice has a row and a column at least")
    rf, cf = (rows if rows_filled is None else rows_filled), (cols if cols_filled is None else cols_filled)
    need(0 <= rf <= rows and 0 <= cf <= cols, "filled rows or columns are more than there are")
    row, col = F.floor(ID("id") / cols).cast("long"), ID("id") % cols
    cells = spark.range(rows * cols)
    east = pairs(cells.filter((row < rf) & (F.lit(loop_rows) | (col < cols - 1))), ID("id"), row * cols + (col + 1) % cols)
    south = pairs(cells.filter((col < cf) & (F.lit(loop_cols) | (row < rows - 1))), ID("id"), ((row + 1) % rows) * cols + col)
    return east.union(south)


def lattice(spark: SparkSession, rows: int, cols: int, loop_rows: bool = False, loop_cols: bool = False) -> Graph:
    return graph_of(spark, rows * cols, lattice_edges(spark, rows, cols, loop_rows, loop_cols))


def counted_out(spark: SparkSession, rows: DataFrame, many: int, name: str) -> DataFrame:
    """Each row with every number below `many`."""
    blocks = rows.withColumn("__hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((many - 1) // COPIES).cast("long"))))
    if many > COPIES:
        blocks = blocks.repartition(min(100_000, many // COPIES + 1), *blocks.columns)
    out = blocks.withColumn("__lo", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(COPIES, many) - 1).cast("long"))))
    return out.withColumn(name, F.col("__hi") * COPIES + F.col("__lo")).filter(F.col(name) < many).drop("__hi", "__lo")


def product(spark: SparkSession, macro_vertices: int, macro: DataFrame, micro_vertices: int, micro: DataFrame, cellwise: bool) -> Graph:
    """Each macro vertex becomes a copy of the micro graph; macro edges join roots, or (cellwise) all equal cells.

    Copies are counted out in two steps, so that no row holds the numbers of all copies; between the steps
    the rows are dealt out, since the micro graph may be few rows in few partitions.
    """
    copies = counted_out(spark, micro.select("src", "dst"), macro_vertices, "copy")
    base = F.col("copy") * micro_vertices
    inner = copies.select((base + F.col("src")).alias("src"), (base + F.col("dst")).alias("dst"))
    outer = macro.select((F.col("src") * micro_vertices).alias("src"), (F.col("dst") * micro_vertices).alias("dst"))
    if cellwise:
        outer = counted_out(spark, outer, micro_vertices, "cell").select((F.col("src") + F.col("cell")).alias("src"), (F.col("dst") + F.col("cell")).alias("dst"))
    return graph_of(spark, macro_vertices * micro_vertices, inner.union(outer))


def lmlmtn(spark: SparkSession, m: int, n: int) -> Graph:
    """A binary tree of height n whose vertices are m x m looped lattices, linked cell by cell."""
    need(m > 0 and n >= 0, "LmLmTn needs m of 1 and n of 0 at least")
    return product(spark, tree_size(n, 2), tree_edges(spark, n, 2), m * m, lattice_edges(spark, m, m, True, True), cellwise=True)


def limlon(spark: SparkSession, m: int, n: int) -> Graph:
    """An m x m lattice whose vertices are n x n looped lattices, linked cell by cell to the right and down."""
    need(m > 0 and n > 0, "LimLon needs m and n of 1 at least")
    return product(spark, m * m, lattice_edges(spark, m, m, False, False), n * n, lattice_edges(spark, n, n, True, True), cellwise=True)


def tree_of(spark: SparkSession, height: int, leaf: Graph, branch: int = 2) -> Graph:
    return product(spark, tree_size(height, branch), tree_edges(spark, height, branch), leaf.size, leaf.edges, cellwise=False)


def line_of(spark: SparkSession, n: int, leaf: Graph) -> Graph:
    return product(spark, n, line(spark, n).edges, leaf.size, leaf.edges, cellwise=False)


def lattice_of(spark: SparkSession, rows: int, cols: int, leaf: Graph, loop_rows: bool = False, loop_cols: bool = False, rows_filled: int | None = None, cols_filled: int | None = None) -> Graph:
    macro = lattice_edges(spark, rows, cols, loop_rows, loop_cols, rows_filled, cols_filled)
    return product(spark, rows * cols, macro, leaf.size, leaf.edges, cellwise=False)


def ring_with_shortcuts(spark: SparkSession, n: int, shortcuts: int, seed: int = 1) -> Graph:
    """A ring with `shortcuts` random targets more for each vertex."""
    need(n > 0 and shortcuts >= 0, "a ring with shortcuts needs a vertex, and shortcuts of 0 at least")
    extra = spark.range(n * shortcuts).select(F.floor(ID("id") / max(1, shortcuts)).alias("src"), F.floor(scalar.uniform(seed, "id") * n).alias("dst"))
    return graph_of(spark, n, ring(spark, n).edges.union(extra))


def slow_erdos(spark: SparkSession, n: int, p: float, seed: int = 1) -> Graph:
    """Every ordered pair, loops included, with probability p: a draw for each of n*n numbers."""
    need(n > 0 and 0 <= p <= 1, "a random graph needs a vertex, and p from 0 to 1")
    hit = spark.range(n * n).filter(scalar.uniform(seed, "id") < p)
    return graph_of(spark, n, pairs(hit, F.floor(ID("id") / n), ID("id") % n))


@dataclass(frozen=True)
class Degrees:
    """A law of out-degrees: a draw for (seed, keys)."""

    kind: str
    a: float = 0.0
    b: float = 0.0

    def draw(self, seed: int, *keys: Column | str) -> Column:
        if self.kind == "lognormal":
            return scalar.log_normal(self.a, self.b, seed, *keys)
        if self.kind == "uniform":
            return scalar.between(self.a, self.b, seed, *keys)
        if self.kind == "discrete":
            return scalar.discrete_between(int(self.a), int(self.b), seed, *keys)
        if self.kind == "normal":
            return self.a + self.b * scalar.normal(seed, *keys)
        if self.kind == "pareto":
            return scalar.pareto(self.a, self.b, seed, *keys)
        if self.kind == "binomial":
            return scalar.binomial(int(self.a), self.b, seed, *keys)
        if self.kind == "nearly binomial":
            return scalar.binomial_by_normal(int(self.a), self.b, seed, *keys)
        if self.kind == "power":
            return scalar.power_law(1.0, self.a, self.b, seed, *keys)
        raise GraphSpecError(f"no such law of degrees: {self.kind}")


def degree_distribution(spark: SparkSession, n: int, law: Degrees, seed: int = 1, distinct: bool = False) -> Graph:
    """Out-degrees drawn from the law, rounded, drawn anew while out of 0..32767; uniform targets.

    A law that gives no degree in TRIES draws is an error. distinct: no target twice for a source, and all
    sets of targets alike: a source takes its first targets that differ out of a sequence of draws, or,
    where it wants a quarter of all vertices or more, the first vertices in a random order of its own;
    degrees above n are drawn anew as well.
    """
    need(n > 0, "a graph has a vertex at least")
    top = min(MOST_DEGREE, n) if distinct else MOST_DEGREE

    def first_of(ks: Column) -> Column:
        draws = F.transform(ks, lambda k: F.round(law.draw(seed, k, "id")).cast("double"))
        return F.try_element_at(F.filter(draws, lambda d: (d >= 0) & (d <= top)), F.lit(1))

    early, late = F.sequence(F.lit(0), F.lit(3)), F.sequence(F.lit(4), F.lit(TRIES - 1))
    none = F.raise_error(F.lit("the law gives no degree in range")).cast("double")
    degree = F.coalesce(first_of(early), F.when(F.col("id").isNotNull(), first_of(late)), none)
    rows = spark.range(n).select("id", degree.cast("long").alias("degree")).filter("degree > 0")
    target = F.floor(scalar.uniform(seed + 1, "id", "k") * n)
    if not distinct:
        drawn = rows.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree"))).alias("k"))
        return graph_of(spark, n, drawn.select(F.col("id").alias("src"), target.alias("dst")))
    few = rows.filter(F.col("degree") * 4 < n)
    drawn = few.select("id", "degree", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree") * 4 + 64)).alias("k")).select("id", "degree", "k", target.alias("dst"))
    firsts = drawn.groupBy("id", "dst").agg(F.min("k").alias("at"), F.first("degree").alias("degree"))
    many = rows.filter(F.col("degree") * 4 >= n).select("id", "degree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst"))
    many = many.select("id", "dst", F.xxhash64(F.lit(seed + 2), "id", "dst").alias("at"), "degree")  # n is at most four times a degree here
    both = firsts.select("id", "dst", "at", "degree").union(many) if n > 4 else many
    ordered = both.groupBy("id").agg(F.first("degree").alias("degree"), F.sort_array(F.collect_list(F.struct("at", "dst"))).alias("t"))  # at most 4 * 32767 + 64 of them
    enough = F.when(F.size("t") >= F.col("degree"), F.slice("t", 1, F.col("degree").cast("int"))).otherwise(F.raise_error(F.lit("too few targets differ")))
    return graph_of(spark, n, ordered.select(F.col("id").alias("src"), F.explode(enough).alias("x")).select("src", "x.dst"))


def ordered_tree(spark: SparkSession, m: int, n: int) -> Graph:
    """LmLmOTn: a binary tree of height n of m x m looped lattices, joined at their roots; left children hang below, right children point up.

    In pre-order the left child of v is v+1, any other child a right one.
    """
    down = tree_edges(spark, n, 2)
    left = F.col("dst") == F.col("src") + 1
    macro = down.select(F.when(left, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(left, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    return product(spark, tree_size(n, 2), macro, m * m, lattice_edges(spark, m, m, True, True), cellwise=False)


def rooted_tree(spark: SparkSession, m: int, n: int) -> Graph:
    """LmLmBTn: a binary tree of height n of m x m looped lattices (single vertices have no loops), joined at their roots."""
    return tree_of(spark, n, lattice(spark, m, m, m > 1, m > 1))
