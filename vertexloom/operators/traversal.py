"""Traversals: hop distances, layers, search trees, reach, waves, covers, and spreading.

Edges with a null end and sources that are null are left out; parallel edges and loops change nothing but
the counts that speak of edges. An empty graph has no rows (one row of zeros where a result is one row).
Further columns of vertices and edges are left aside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .iterate import Layers, placed

UNREACHED = 2147483647
# A frontier of at most FEW rows goes HOPS edges in one round.
FEW, HOPS = 256, 3
# From this round on a label is also replaced by the label of the vertex it names.
JUMP_FROM = 4


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, dist): least number of edges from any source (id).

    A round joins the frontier alone. A small frontier goes several edges a round: what is met is given the
    least number of edges it was met by, and the next frontier is what lies farthest out.
    """
    first = sources.filter("id is not null").select(F.col("id").cast("long").alias("id")).distinct().withColumn("dist", F.lit(0))
    with placed(edges.select("src", "dst")) as near, Layers(edges.sparkSession, "reach") as found:
        frontier, rows = found.add(first)
        depth = 0
        while rows:
            hops = HOPS if rows <= FEW else 1
            layer, ahead = frontier, None
            for k in range(1, hops + 1):
                layer = near.follow(layer.select("id")).select(F.col("dst").alias("id")).distinct()
                met = layer.withColumn("dist", F.lit(depth + k))
                ahead = met if ahead is None else ahead.union(met)
            if hops > 1:
                ahead = ahead.groupBy("id").agg(F.min("dist").alias("dist"))
            depth += hops
            new, rows = found.add(ahead.join(found.whole().select("id"), "id", "left_anti"), f"dist = {depth}")
            frontier = new.filter(F.col("dist") == depth)
        return found.result()


def reach_set(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id): what any source (id) reaches; HOPS edges a round, as no distance is asked for."""
    first = sources.filter("id is not null").select("id").distinct()
    with placed(edges.select("src", "dst")) as near, Layers(edges.sparkSession, "reach_set") as found:
        frontier, rows = found.add(first)
        while rows:
            layer, ahead = frontier, None
            for _ in range(HOPS):
                layer = near.follow(layer).select(F.col("dst").alias("id")).distinct()
                ahead = layer if ahead is None else ahead.union(layer)
            frontier, rows = found.add(ahead.distinct().join(found.whole(), "id", "left_anti"))
        return found.result()


def spread(labels: DataFrame, edges: DataFrame, largest: bool = True) -> DataFrame:
    """(id, label): the largest (or least) label among a vertex's ancestors and its own; labels are ids.

    Rounds write only what changed. A label names an ancestor, so the label of the named vertex is one of
    an ancestor as well: long paths are shortened by that.
    """
    best = F.max if largest else F.min
    better = "got > label" if largest else "got < label"
    with placed(edges.select("src", "dst")) as near, Layers(edges.sparkSession, "spread", {"label": best}) as found:
        active, rows = found.add(labels.filter("id is not null").select("id", "label"))
        while rows:
            layer, sent = active, None
            for _ in range(HOPS):
                layer = near.follow(layer).groupBy(F.col("dst").alias("id")).agg(best("label").alias("label"))
                sent = layer if sent is None else sent.union(layer)
            sent = sent.groupBy("id").agg(best("label").alias("got"))
            now = found.whole()
            new = sent.join(now, "id").filter(better).select("id", F.col("got").alias("label"))
            if found.number >= JUMP_FROM:
                far = now.select(F.col("id").alias("label"), F.col("label").alias("far"))
                new = new.join(far, "label", "left").select("id", (F.greatest if largest else F.least)("label", "far").alias("label"))
            active, rows = found.add(new)
        return found.result()


def start(graph: Graph, root: int | None) -> DataFrame:
    root = graph.first_vertex() if root is None else root
    return graph.spark.createDataFrame([(root,)] if root is not None else [], "id long")


def hop_distance(graph: Graph, root: int | None = None, compat: bool = False) -> DataFrame:
    """(id, dist) of every vertex; unreached is null, in compat the largest int."""
    found = reach(graph.edges, start(graph, root))
    dist = F.coalesce("dist", F.lit(UNREACHED)) if compat else F.col("dist")
    return graph.vertices.filter("id is not null").select("id").join(found, "id", "left").select("id", dist.alias("dist"))


def search_tree(graph: Graph, root: int | None = None) -> DataFrame:
    """(id, dist, father) of the vertices reached: the father is the least vertex one edge nearer to the root, null for the root."""
    found = reach(graph.edges, start(graph, root))
    near = found.select(F.col("id").alias("src"), (F.col("dist") + 1).alias("dist"))
    far = found.select(F.col("id").alias("dst"), "dist")
    fathers = graph.edges.select("src", "dst").join(near, "src").join(far, ["dst", "dist"]).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("father"))
    return found.join(fathers, "id", "left").select("id", "dist", "father")


def to_father(tree: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(id, value): for each vertex of a tree (id, father), the value (id, value) of the vertex it has stored as its father; null for the root."""
    theirs = values.select(F.col("id").alias("father"), F.col(value).alias("__theirs"))
    return tree.select("id", "father").join(theirs, "father", "left").select("id", F.col("__theirs").alias(value))


def echo_sizes(tree: DataFrame) -> DataFrame:
    """(id, size): vertices below and including each one of a search tree (id, dist, father).

    The echo: from the farthest layer on, each vertex sends its sum to its stored father; a layer is sent
    once all of it has been received.
    """
    deepest = tree.agg(F.max("dist")).first()[0]
    with Layers(tree.sparkSession, "echo") as done:
        for depth in range(deepest if deepest is not None else -1, -1, -1):
            own = tree.filter(F.col("dist") == depth).select("id", "father")
            if done.layers:
                got = done.layers[-1].groupBy(F.col("father").alias("id")).agg(F.sum("size").alias("got"))
                own = own.join(got, "id", "left").select("id", "father", (1 + F.coalesce("got", F.lit(0))).cast("long").alias("size"))
            else:
                own = own.withColumn("size", F.lit(1).cast("long"))
            done.add(own)
        return done.result().select("id", "size") if done.layers else tree.select("id", F.lit(1).cast("long").alias("size"))


def bfs_layers(graph: Graph, root: int | None = None, compat: bool = False) -> DataFrame:
    """(dist, cnt): vertices by distance; in compat the root's neighbours count as layer 0."""
    found = reach(graph.edges, start(graph, root))
    dist = F.greatest(F.col("dist") - 1, F.lit(0)) if compat else F.col("dist")
    return found.groupBy(dist.alias("dist")).agg(F.count(F.lit(1)).alias("cnt"))


def bfs_summary(graph: Graph, root: int | None = None) -> DataFrame:
    """One row: visited vertices, number of layers, average distance of the visited."""
    found = reach(graph.edges, start(graph, root))
    return found.agg(F.count(F.lit(1)).alias("visited"), (F.max("dist") + 1).alias("layers"), F.round(F.avg("dist"), 6).alias("avg_dist"))


def visit_count(graph: Graph, root: int | None = None) -> DataFrame:
    """One row: vertices reached, and visit calls (one for the root and one for every edge out of a reached vertex)."""
    found = reach(graph.edges, start(graph, root))
    calls = found.join(graph.out_degrees(), "id", "left")
    return calls.agg(F.count(F.lit(1)).alias("visited"), (F.coalesce(F.sum("degree"), F.lit(0)) + 1).alias("visit_calls"))


def visit_all(graph: Graph) -> DataFrame:
    """One row: vertices visited and rounds, when each round visits what its pivot reaches and pivots are taken in the order of ids.

    A vertex is a pivot if no smaller vertex reaches it, so the pivots are the vertices whose least
    ancestor (itself included) is their own. The round that finds no pivot left counts as well.
    """
    state = spread(graph.vertices.select("id", F.col("id").alias("label")), graph.edges, largest=False)
    return state.agg(F.count(F.lit(1)).alias("visited"), (F.count(F.when(F.col("id") == F.col("label"), 1)) + 1).alias("rounds"))


def echo(graph: Graph, root: int | None = None) -> DataFrame:
    """One row: vertices that a wave over edges in both directions reaches from the root and that echo back."""
    found = reach_set(graph.undirected().edges, start(graph, root))
    return found.agg(F.count(F.lit(1)).alias("echoes"))


def cascade(graph: Graph, seeds: DataFrame, p: float = 0.51, seed: int = 1) -> DataFrame:
    """(id) used by an independent cascade: edges live with probability p, seeds take with p as well.

    What the seeds reach over live edges is found over the contracted graph, so long ways take no rounds of their own.
    An edge's draw is a hash of its ends and its number among equal edges, so it does not hang on layout.
    """
    from .reach import reached  # it is built on this module

    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 30)) / F.lit(float(1 << 30)) < p
    many = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    alive = many.filter(F.exists(F.sequence(F.lit(1), F.col("n")), lambda k: draw("src", "dst", k)))
    return reached(alive, seeds.filter(draw("id", F.lit(0))))


def cascade_seeds(graph: Graph, count: int, seed: int = 1) -> DataFrame:
    """The `count` vertices with the least hash: a random set that does not hang on layout."""
    return graph.vertices.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(count)
