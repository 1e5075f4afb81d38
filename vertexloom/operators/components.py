"""Strongly connected components, their quotient, depths, and terminal components.

Vertices and edge ends that are null take no part; parallel edges and loops change nothing; ends of edges
that are no vertices are not listed. An empty graph has an empty result. Further columns are left aside.

Where few edges are left (`finish`), one task ends the work by a depth-first search over them: a
bound on the rows in that task, which takes the place of many rounds over nearly nothing. The result is
the same for any bound; 0 keeps all work in rounds. Chains, and above `block` edges ranges of ids, are
contracted first (`contract`), which changes no result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..storage import stored
from .contract import BLOCK, Contraction, in_ranges, range_bounds
from .iterate import counted, logged, moved, parts_of
from .traversal import spread
from .traversal import reach_set as reach_rounds

TRIM_PASSES = 3
FINISH = 100_000
# Reach goes by ranges of ids up to so many of them.
RANGED = 20


def simple_edges(graph: Graph, most: int | None = None) -> tuple[DataFrame, int, bool]:
    """Edges without loops between vertices that are not null, stored; how many; whether they are distinct, as they are up to `most` (none: always)."""
    edges = graph.edges.filter("src <> dst").select("src", "dst")
    if graph.once or most is None:
        return *counted(edges if graph.once else edges.repartition(parts_of(graph.spark), "src", "dst").distinct(), "edges"), True
    edges, rows = counted(edges, "edges")
    if rows > most:
        return edges, rows, False
    return *counted(edges.repartition(parts_of(graph.spark), "src", "dst").distinct(), "edges"), True


def smaller(graph: Graph, few: int, block: int) -> tuple[DataFrame, int, Contraction]:
    """simple_edges, contracted while more than `few`: they, their number, and the way back."""
    edges, rows, once = simple_edges(graph, max(few, block))
    small = Contraction(edges, rows, depth_first, few, block, trim, once)
    return small.edges, small.rows, small


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def spreading(ids: list[int], via: list[int], hit: list[int]) -> list[tuple[int, int | None, bool]]:
    """What is reached as far as these edges (via to id) tell: (id, none, false) of ids that are, (id, via, true) of edges into others. hit: 1 where via is reached."""
    todo = list({i for i, h in zip(ids, hit, strict=True) if h})
    seen = set(todo)
    ahead: dict[int, list[int]] = {}
    for i, v in zip(ids, via, strict=True):
        ahead.setdefault(v, []).append(i)
    for v in todo:  # grows as it goes
        for i in ahead.get(v, ()):
            if i not in seen:
                seen.add(i)
                todo.append(i)
    return [(i, None, False) for i in todo] + [(i, v, True) for i, v in zip(ids, via, strict=True) if i not in seen]


def reach_set(edges: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id): what any source (id) reaches. Up to RANGED times `block` edges a round follows paths, in a task for each range of targets, as far as they stay within it; beyond, rounds of a few edges move the frontier alone."""
    edges, rows = counted(edges.select(F.col("dst").alias("id"), F.col("src").alias("via")), "reach")
    if rows > RANGED * block:
        return reach_rounds(edges.select(F.col("via").alias("src"), F.col("id").alias("dst")), sources)
    first = stored(sources.filter("id is not null").select("id").distinct(), "reach")
    return followed_on(edges, rows, first, spreading, "reach_set", block).distinct()


def followed_on(edges: DataFrame, rows: int, first: DataFrame, rule: Callable[[list[int], list[int], list[int]], list[tuple[int, int | None, bool]]], loop: str, block: int) -> DataFrame:
    """(id): first, and what follows from it by a rule over edges (id, via), as far as it goes within a range of ids in a round."""
    bounds = range_bounds(edges.select(F.col("id").alias("src")), rows, block) if rows else []

    def task(pieces: Iterator[list[list]]) -> Iterator[pa.RecordBatch]:
        for piece in pieces:
            out = rule(*piece)
            yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["id", "via", "open"])

    new, parts, open_ = first, [first], edges
    while True:
        began = time.time()
        hit = open_.join(new.select(F.col("id").alias("via"), F.lit(1).cast("long").alias("hit")), "via", "left").select("id", "via", F.coalesce("hit", F.lit(0).cast("long")).alias("hit"))
        state, many = counted(in_ranges(hit, bounds, parts_of(edges.sparkSession), task, "id long, via long, open boolean"), loop, "not open")
        new, open_ = state.filter("not open").select("id"), state.filter("open").select("id", "via")
        logged(loop, len(parts), many, time.time() - began)
        if many:
            parts.append(new)
        if not many or not bounds:
            return together(parts)


def peeling(ids: list[int], via: list[int], gone: list[int]) -> list[tuple[int, int | None, bool]]:
    """What goes as far as these edges (via to id) tell, where an id goes once all edges into it come from what has gone: (id, none, false) of ids that go, (id, via, true) of edges out of what is left. gone: 1 where via has."""
    waits: dict[int, int] = {}
    ahead: dict[int, list[int]] = {}
    for i, v, g in zip(ids, via, gone, strict=True):
        waits.setdefault(i, 0)
        if not g:
            waits[i] += 1
            ahead.setdefault(v, []).append(i)
    todo = [i for i, n in waits.items() if not n]
    for v in todo:  # grows as it goes
        for i in ahead.pop(v, ()):
            waits[i] -= 1
            if not waits[i]:
                todo.append(i)
    return [(i, None, False) for i in todo] + [(i, v, True) for v, targets in ahead.items() for i in targets]


def peel(edges: DataFrame, rows: int, first: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id): first (id), stored vertices without an edge in, and all whose edges in come from such only, however long the paths within a range."""
    return followed_on(edges.select(F.col("dst").alias("id"), F.col("src").alias("via")), rows, first, peeling, "peel", block)


def in_one_task(rows: DataFrame, run: Callable[[list[int], list[int]], list[tuple[int, int]]], schema: str) -> DataFrame:
    """run over the pairs of a table whose size has been checked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for x in batches:
            a += x.column(0).to_pylist()
            b += x.column(1).to_pylist()
        out = run(a, b)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return rows.coalesce(1).mapInArrow(task, schema)


def depth_first(src: list[int], dst: list[int]) -> list[tuple[int, int]]:
    """(id, least id of its component) of the ends of the edges, by one depth-first search with a stack of open vertices."""
    ahead: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    closed: set[int] = set()
    open_, out = [], []
    for first in ahead:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        open_.append(first)
        path = [(first, iter(ahead[first]))]
        while path:
            v, rest = path[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    open_.append(w)
                    path.append((w, iter(ahead[w])))
                    break
                if w not in closed:
                    low[v] = min(low[v], number[w])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
                if low[v] == number[v]:
                    at = len(open_) - 1
                    while open_[at] != v:
                        at -= 1
                    members = open_[at:]
                    del open_[at:]
                    closed.update(members)
                    least = min(members)
                    out += [(x, least) for x in members]
    return out


def within(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, label): edges whose ends have the same label (any comparable column)."""
    a = labels.select(F.col("id").alias("src"), F.col("label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    return edges.join(a, "src").join(b, "dst").filter("label = other").select("src", "dst", "label")


def trim(edges: DataFrame, rows: int, rounds: int = 3, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Takes away edges on no cycle: those out of a vertex without an edge in, or into one without an edge out.

    Up to RANGED times `block` edges all of these go, however long their paths (`peel`). Beyond, TRIM_PASSES
    passes are one plan, and rounds go on while many edges go. A vertex without an edge left is alone in its component.
    """
    if rows <= RANGED * block:
        for _ in range(2):  # ahead, then backward; what goes backward frees nothing ahead
            if rows:
                first, many = counted(edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti"), "ends")
                if many:
                    gone = peel(edges, rows, first, block)
                    edges, rows = counted(edges.join(moved(gone.withColumnRenamed("id", "src")), "src", "left_anti").select("src", "dst"), "edges")
            edges = flipped(edges)
        return edges, rows
    for _ in range(rounds):
        new = edges
        for _ in range(TRIM_PASSES):
            fed, open_ = new.select(F.col("dst").alias("src")).distinct(), new.select(F.col("src").alias("dst")).distinct()
            new = new.join(fed, "src", "left_semi").join(open_, "dst", "left_semi")
        edges, left = counted(new.select("src", "dst"), "edges")
        shrunk, rows = rows - left, left
        if not rows or shrunk * 20 < rows:
            break
    return edges, rows


def together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.union(x)
    return whole


def named(graph: Graph, parts: list[DataFrame], small: Contraction | None = None) -> DataFrame:
    """(id, comp) of all vertices with the least id of each component; parts are disjoint (id, comp), others are alone. small: what parts are over."""
    vertices = graph.vertices.filter("id is not null").select("id")
    if small is not None and small.levels:
        none = vertices.limit(0).select("id", F.col("id").alias("comp"))
        parts = [small.expand(stored(together(parts), "parts") if parts else none, alone=True)]
    if not parts:
        return vertices.select("id", F.col("id").alias("comp"))
    whole = together(parts)
    least = whole.groupBy("comp").agg(F.min("id").alias("least"))
    found = whole.join(moved(least), "comp").select("id", "least")
    return stored(vertices.join(moved(found), "id", "left").select("id", F.coalesce("least", "id").alias("comp")), "components")


def largest_part(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """What a vertex with many edges in and out reaches and is reached by; the edges beside it that may lie on other cycles; their number."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    weight = ends.groupBy("id").agg((F.sum("o").cast("double") * F.sum("i")).alias("w"))
    pivot = weight.agg(F.max(F.struct("w", "id")).alias("top")).select(F.col("top.id").alias("id"))
    pivot = stored(pivot, "pivot")
    ahead, behind = reach_set(edges, pivot), reach_set(flipped(edges), pivot)
    marks = stored(ahead.withColumn("f", F.lit(1)).join(behind.withColumn("b", F.lit(1)), "id", "full_outer").select("id", (F.coalesce("f", F.lit(0)) + 2 * F.coalesce("b", F.lit(0))).alias("mark")), "marks")
    part = marks.filter("mark = 3").select("id", F.lit(-1).cast("long").alias("comp"))
    a, b = marks.select(F.col("id").alias("src"), F.col("mark").alias("m")), marks.select(F.col("id").alias("dst"), F.col("mark").alias("n"))
    rest = edges.join(a, "src", "left").join(b, "dst", "left").filter("coalesce(m, 0) = coalesce(n, 0) and coalesce(m, 0) <> 3").select("src", "dst")
    rest, left = counted(rest, "edges")
    return part, rest, left


def strong_components(graph: Graph, finish: int = FINISH, block: int = BLOCK) -> DataFrame:
    """(id, comp), in steps: trimming, the largest component by reach from one vertex both ways, then colouring.

    All subproblems of colouring go on together: colours are the largest ids passed along the edges; a
    vertex that keeps its own is a head, and what reaches it within its colour is its component. Edges
    between colours lie on no cycle and are dropped for good.
    """
    edges, rows, small = smaller(graph, finish, block)
    parts: list[DataFrame] = []
    if rows > finish:
        edges, rows = trim(edges, rows, block=block)
    if rows > finish:
        part, edges, rows = largest_part(edges)
        parts.append(part)
        if rows > finish:
            edges, rows = trim(edges, rows, block=block)
    while rows > finish:
        colours = spread(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label")), edges)
        inner = stored(within(edges, colours), "inner")
        found = reach_set(flipped(inner), colours.filter("id = label").select("id"))
        part = stored(found.join(colours, "id").select("id", F.col("label").alias("comp")), "part")
        parts.append(part)
        done = part.select(F.col("id").alias("src"))
        edges, rows = counted(inner.select("src", "dst").join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti"), "edges")
        if rows > finish:
            edges, rows = trim(edges, rows, block=block)
    if rows:
        parts.append(in_one_task(edges, depth_first, "id long, comp long"))
    return named(graph, parts, small)


def strong_components_fb(graph: Graph, finish: int = FINISH, candidates: bool = False, block: int = BLOCK) -> DataFrame:
    """(id, comp), by forward and backward reach from a pivot in every open part at once; what neither, one or the other reaches are new parts.

    candidates: the sizes of new parts and a pivot for each are found while vertices are marked, so no
    scan looks for pivots, a part that is one vertex is closed at once, and so is a part that its pivot's component fills.
    """
    edges, rows, small = smaller(graph, finish, block)
    labels: DataFrame | None = None
    parts: list[DataFrame] = []
    while rows > finish:
        if labels is None or not candidates:
            edges, rows = trim(edges, rows, block=block)
            if rows <= finish:
                break
            ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
            labels = stored(ends.withColumn("label", F.lit(0).cast("long")) if labels is None else labels.select("id", "label").join(ends, "id", "left_semi"), "labels")
            pivots = stored(labels.groupBy("label").agg(F.min("id").alias("id")), "pivots")
        else:
            pivots = labels.filter("id = pivot").select("label", "id")  # found with the labels
        ahead = reach_set(edges, pivots.select("id")).select("id", F.lit(True).alias("f"))
        behind = reach_set(flipped(edges), pivots.select("id")).select("id", F.lit(True).alias("b"))
        marked = labels.select("id", "label").join(ahead, "id", "left").join(behind, "id", "left")
        marked = stored(marked.select("id", "label", F.coalesce("f", F.lit(False)).alias("f"), F.coalesce("b", F.lit(False)).alias("b")), "marked")
        both = marked.filter("f and b").join(pivots.withColumnRenamed("id", "comp"), "label").select("id", "comp")
        parts.append(stored(both, "part"))
        rest = marked.filter("not (f and b)")
        names = rest.groupBy("label", "f", "b").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size"))
        new = rest.join(names, ["label", "f", "b"]).select("id", F.col("pivot").alias("label"), "pivot", "size")
        labels = stored(new.filter("size > 1") if candidates else new, "labels")
        edges, rows = counted(within(edges, labels).select("src", "dst"), "edges")
    if rows:
        parts.append(in_one_task(edges, depth_first, "id long, comp long"))
    return named(graph, parts, small)


def strong_components_obf(graph: Graph, finish: int = FINISH, random_pivots: bool = False, seed: int = 1, nesting: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, comp), by slices: one-way catch them young, backward reach, forward seeds.

    In every open part a pivot's forward reach is a chunk. A chunk is cut into slices from the pivot on:
    vertices of the front without an edge in from the chunk's rest are components of their own and go, and
    their targets come to the front; what reaches the front that is left is a slice, closed under
    components; the slice's targets are the next front. Slices and what no pivot reached are the next parts. A first
    slice of which nothing went is the pivot's component. All parts go on together. random_pivots: pivots
    by a hash, not the least id. nesting: after so many rounds of slices, colouring ends the rest.
    """
    edges, rows, small = smaller(graph, finish, block)
    parts: list[DataFrame] = []
    labels = None
    level = 0
    while rows > finish and (nesting is None or level < nesting):
        level += 1
        if level > 1:
            edges, rows = trim(edges, rows, block=block)
            if rows <= finish:
                break
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        labels = stored(ends.withColumn("label", F.lit(0).cast("long")) if labels is None else labels.join(ends, "id", "left_semi"), "labels")
        order = F.xxhash64(F.lit(seed), F.lit(level), "id") if random_pivots else F.col("id")
        pivots = stored(labels.groupBy("label").agg(F.min(F.struct(order.alias("o"), "id")).alias("p")).select("label", F.col("p.id").alias("id")), "pivots")
        chunk = stored(reach_set(edges, pivots.select("id")).join(labels, "id"), "chunk")  # edges lie within parts
        range_, inner_rows = counted(within(edges, chunk), "range")
        front, first = pivots.select("id"), True
        alive = chunk.select("id", "label")
        slices: list[DataFrame] = []
        while True:
            fed = range_.select(F.col("dst").alias("id")).distinct()
            loose, many = counted(front.join(alive, "id", "left_semi").join(fed, "id", "left_anti"), "gone")
            if many:  # vertices of the front without an edge in go, and so does what only they lead to
                gone = stored(peel(range_, inner_rows, loose, block), "gone")
                out = gone.select(F.col("id").alias("src"))
                ahead = range_.join(out, "src", "left_semi").select(F.col("dst").alias("id"))
                front = front.union(ahead).distinct().join(gone, "id", "left_anti")
                range_, inner_rows = counted(range_.join(out, "src", "left_anti"), "range")
                alive = stored(alive.join(gone, "id", "left_anti"), "alive")
            front, many = counted(front.join(alive, "id", "left_semi"), "front")
            if not many:
                break
            body = stored(reach_set(flipped(range_), front).join(alive, "id").select("id", "label"), "slice")
            slices.append(body.select("id", F.struct("label", F.lit(len(slices)).alias("slice")).alias("label")))
            if first:
                untouched = body.join(pivots.select(F.col("label"), F.col("id").alias("pivot")).join(front.withColumnRenamed("id", "pivot"), "pivot", "left_semi"), "label")
                parts.append(stored(untouched.select("id", F.col("pivot").alias("comp")), "part"))
                first = False
            own = body.select(F.col("id").alias("src"))
            leaving = range_.join(own, "src", "left_semi").join(own.withColumnRenamed("src", "dst"), "dst", "left_anti")
            front = stored(leaving.select(F.col("dst").alias("id")).distinct(), "front")
            range_, inner_rows = counted(range_.join(own, "src", "left_anti").join(own.withColumnRenamed("src", "dst"), "dst", "left_anti"), "range")
            alive = stored(alive.join(body, "id", "left_anti"), "alive")
        rest = labels.join(chunk, "id", "left_anti").select("id", F.struct("label", F.lit(-1).alias("slice")).alias("label"))
        for x in slices:
            rest = rest.union(x)
        if parts:
            rest = rest.join(parts[-1].select("id"), "id", "left_anti")
        rest = stored(rest, "rest")
        names = rest.groupBy("label").agg(F.min("id").alias("name"))
        labels = stored(rest.join(names, "label").select("id", F.col("name").alias("label")), "labels")
        edges, rows = counted(within(edges, labels).select("src", "dst"), "edges")
    if rows > finish:
        tail = strong_components(Graph(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges), finish, block)
        parts.append(tail)
    elif rows:
        parts.append(in_one_task(edges, depth_first, "id long, comp long"))
    return named(graph, parts, small)


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def size_histogram(components: DataFrame) -> DataFrame:
    """(size, n): how many components have a size."""
    return component_sizes(components).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def quotient(graph: Graph, components: DataFrame) -> DataFrame:
    """(src_comp, dst_comp): distinct edges between different components."""
    a = components.select(F.col("id").alias("src"), F.col("comp").alias("src_comp"))
    b = components.select(F.col("id").alias("dst"), F.col("comp").alias("dst_comp"))
    return graph.edges.select("src", "dst").join(moved(a), "src").join(moved(b), "dst").filter("src_comp <> dst_comp").select("src_comp", "dst_comp").distinct()


def merge_components(a: DataFrame, b: DataFrame) -> DataFrame:
    """(comp, size) of both; a component with two sizes is an error."""
    sizes = a.select("comp", "size").union(b.select("comp", "size")).distinct()
    checked = sizes.groupBy("comp").agg(F.min("size").alias("size"), F.max("size").alias("most"))
    return checked.select("comp", F.when(F.col("size") == F.col("most"), F.col("size")).otherwise(F.raise_error(F.lit("a component has two sizes"))).cast("long").alias("size"))


def nearest_leaves(src: list[int], dst: list[int]) -> list[tuple[int, int]]:
    """(comp, depth) of the sources of edges without a cycle; targets that are no sources are leaves."""
    open_: dict[int, int] = {}
    least: dict[int, int] = {}
    back: dict[int, list[int]] = {}
    for a, b in zip(src, dst, strict=True):
        open_[a] = open_.get(a, 0) + 1
        back.setdefault(b, []).append(a)
    todo = [(b, 0) for b in back if b not in open_]
    out = []
    for comp, depth in todo:  # grows as it goes
        for a in back.get(comp, ()):
            open_[a] -= 1
            least[a] = min(least.get(a, depth), depth)
            if not open_[a]:
                out.append((a, least[a] + 1))
                todo.append((a, least[a] + 1))
    return out


def settled(src: list[int], dst: list[int | None], depth: list[int | None]) -> list[tuple[int, int | None, int | None, bool]]:
    """Depths counted down as far as these edges tell: (id, none, depth, false) of sources that have one, (id, target, none, true) and (id, none, least depth so far, true) of the others.

    depth: of the target, where it is known; a row without a target is the least depth of targets known before.
    """
    waits: dict[int, int] = {}
    least: dict[int, int] = {}
    back: dict[int, list[int]] = {}
    for a, b, d in zip(src, dst, depth, strict=True):
        waits.setdefault(a, 0)
        if d is not None:
            least[a] = min(least.get(a, d), d)
        else:
            waits[a] += 1
            back.setdefault(b, []).append(a)
    todo = [a for a, n in waits.items() if not n]
    out: list[tuple[int, int | None, int | None, bool]] = []
    for b in todo:  # grows as it goes
        found = least[b] + 1
        out.append((b, None, found, False))
        for a in back.pop(b, ()):
            waits[a] -= 1
            least[a] = min(least.get(a, found), found)
            if not waits[a]:
                todo.append(a)
    out += [(a, b, None, True) for b, sources in back.items() for a in sources]
    return out + [(a, None, least[a], True) for a, n in waits.items() if n and a in least]


def quotient_depths(components: DataFrame, edges: DataFrame, finish: int = FINISH, block: int = BLOCK) -> DataFrame:
    """(comp, depth): 0 without targets, else one more than the least depth of the targets, once all have one. A cycle is an error.

    Targets are counted down: a round settles, in a task for each range of sources with at most `block` edges,
    all sources whose targets are settled, however long the paths within the range; the depths it found
    go to the sources in other ranges. So rounds grow with the ranges that a path passes, not with its edges.
    (The edges of one source lie in one range.)
    """
    comps = components.filter("comp is not null").select("comp").distinct()
    edges, rows = counted(edges.select("src_comp", "dst_comp").filter("src_comp is not null and dst_comp is not null").distinct(), "quotient")
    if rows <= finish:
        found = in_one_task(edges, nearest_leaves, "comp long, depth long").select("comp", F.col("depth").cast("int").alias("depth"))
        found, many = counted(found, "depths")
        if many < edges.select("src_comp").distinct().count():
            raise ValueError("the quotient has a cycle")
        return comps.join(found, "comp", "left").select("comp", F.coalesce("depth", F.lit(0)).alias("depth"))
    spark = edges.sparkSession
    bounds = range_bounds(edges.select(F.col("src_comp").alias("src")), rows, block)
    sources = edges.select(F.col("src_comp").alias("dst_comp"), F.lit(False).alias("leaf")).distinct()
    open_ = edges.join(sources, "dst_comp", "left").select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"), F.when(F.coalesce("leaf", F.lit(True)), 0).cast("long").alias("depth"))
    parts: list[DataFrame] = []

    def task(pieces: Iterator[list[list]]) -> Iterator[pa.RecordBatch]:
        for src, dst, depth in pieces:
            out = settled(src, dst, depth)
            yield pa.record_batch([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["id", "dst", "depth", "open"])

    while rows:
        began = time.time()
        state, rows = counted(in_ranges(open_, bounds, parts_of(spark), task, "id long, dst long, depth long, open boolean"), "settled", "open")
        new = state.filter("not open").select("id", "depth")
        parts.append(new)
        logged("depths", len(parts), rows, time.time() - began)
        if rows:
            if new.isEmpty():
                raise ValueError("the quotient has a cycle")
            if bounds and rows <= block:
                bounds = []
            known = new.select(F.col("id").alias("dst"), F.col("depth").alias("known"))
            open_ = state.filter("open").join(known, "dst", "left").select(F.col("id").alias("src"), "dst", F.coalesce("known", "depth").alias("depth"))
    found = together(parts).select(F.col("id").alias("comp"), F.col("depth").cast("int").alias("depth"))
    return comps.join(found, "comp", "left").select("comp", F.coalesce("depth", F.lit(0)).alias("depth"))


def terminal_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(comp) without an edge to another component."""
    return components.select("comp").distinct().join(edges.select(F.col("src_comp").alias("comp")).distinct(), "comp", "left_anti")


FEW = 64


def terminal_smaller(graph: Graph, few: int, block: int) -> tuple[Graph, Contraction]:
    """The graph contracted, with distinct edges without loops, and the way back. Where edges end outside the vertices nothing is contracted."""
    edges, rows, once = simple_edges(graph, max(few, block) if graph.spanned else None)
    vertices = graph.vertices.filter("id is not null").select("id")
    if rows > few and not graph.spanned and not edges.select(F.explode(F.array("src", "dst")).alias("id")).join(vertices, "id", "left_anti").isEmpty():
        few = rows
    small = Contraction(edges, rows, depth_first, few, block, once=once)
    if small.levels:
        vertices = stored(small.vertices(vertices), "vertices")
    return Graph(vertices, small.edges), small


def terminal_first(src: list[int], dst: list[int]) -> list[tuple[int, int]]:
    """(id, least id of its component) of the members of terminal components that have an edge."""
    out = depth_first(src, dst)
    comp = dict(out)
    leaving = {comp[a] for a, b in zip(src, dst, strict=True) if comp[a] != comp[b]}
    return [x for x in out if x[1] not in leaving]


def terminal_rest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) of the members of terminal components of a graph whose number of edges has been checked."""
    alone = vertices.select("id").join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_anti")
    return stored(alone.select("id", F.col("id").alias("comp")).union(in_one_task(edges, terminal_first, "id long, comp long")), "terminal")


def terminal_named(found: DataFrame, small: Contraction) -> DataFrame:
    """(id, comp) of all members with the least id of each component, from those of the contracted graph."""
    if not small.levels:
        return found
    whole = small.expand(stored(found, "terminal"), alone=False)
    least = whole.groupBy("comp").agg(F.min("id").alias("least"))
    return whole.join(least, "comp").select("id", F.col("least").alias("comp"))


def terminal_by_colour(graph: Graph, few: int = FEW, block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """(id, comp) of the members of terminal components, without all components.

    Colours are the largest ids among descendants. What a head reaches within its colour is a terminal
    component unless an edge leads from there into another colour. Over the contracted graph.
    """
    core, small = terminal_smaller(graph, few, block)
    edges = core.edges
    if small.levels and not small.rows:
        return terminal_named(core.vertices.select("id", F.col("id").alias("comp")), small)
    if small.rows <= finish:
        known = core.vertices.select(F.col("id").alias("src"))
        return terminal_named(terminal_rest(core.vertices, edges.join(known, "src", "left_semi").join(known.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")), small)
    colours = spread(core.vertices.select("id", F.col("id").alias("label")), flipped(edges))
    inner = stored(within(edges, colours).select("src", "dst"), "inner")
    found = stored(reach_set(inner, colours.filter("id = label").select("id"), block).join(colours, "id").select("id", "label"), "found")
    targets = colours.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    leaving = edges.join(found.withColumnRenamed("id", "src"), "src").join(targets, "dst").filter("label <> other").select("label").distinct()
    kept = found.join(leaving, "label", "left_anti")
    return terminal_named(kept.join(kept.groupBy("label").agg(F.min("id").alias("comp")), "label").select("id", "comp"), small)


def terminal_by_reach(graph: Graph, trimmed: bool = True, few: int = FEW, block: int = BLOCK, finish: int = FINISH) -> DataFrame:
    """(id, comp) of the members of terminal components, by reach from a pivot in every open part at once.

    Of a pivot's forward reach, what reaches the pivot is its component: terminal if that is all. Else the
    forward reach without it is a part of its own, for every terminal component the pivot reaches lies
    there. What reaches the forward reach from outside is not terminal and is dropped; the rest of the
    part is the other new part. All parts are closed under their edges. trimmed: vertices without an edge out are
    terminal at once, and what reaches them is dropped, before the first pivot; else after it, for they
    would cost a round each. Over the contracted graph; one task ends the work where at most `finish` edges are left.
    """
    core, small = terminal_smaller(graph, few, block)
    edges = core.edges
    labels, left = counted(core.vertices.select("id", F.lit(0).cast("long").alias("label")), "labels")
    found: list[DataFrame] = []
    due, ended = trimmed, False
    while left:
        edges, rows = counted(within(edges, labels).select("src", "dst"), "edges")
        if rows <= finish:
            found.append(terminal_rest(labels, edges))
            break
        if due and not ended:
            ends = labels.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
            found.append(stored(ends.select("id", F.col("id").alias("comp")), "ends"))
            labels, left = counted(labels.join(reach_set(flipped(edges), found[-1].select("id"), block), "id", "left_anti"), "labels")
            ended = True
            continue
        due = True
        pivots = stored(labels.groupBy("label").agg(F.min("id").alias("id")), "pivots")
        ahead = stored(reach_set(edges, pivots.select("id"), block).join(labels, "id"), "ahead")
        inner = within(edges, ahead).select("src", "dst")
        own = stored(reach_set(flipped(inner), pivots.select("id"), block).join(labels, "id"), "own")
        behind = reach_set(flipped(edges), ahead.select("id"), block)
        sizes = ahead.groupBy("label").agg(F.count(F.lit(1)).alias("f")).join(own.groupBy("label").agg(F.count(F.lit(1)).alias("c")), "label").filter("f = c").select("label")
        ready = own.join(sizes, "label", "left_semi")
        found.append(stored(ready.join(ready.groupBy("label").agg(F.min("id").alias("comp")), "label").select("id", "comp"), "terminal"))
        inside = ahead.join(own.select("id"), "id", "left_anti").select("id", F.struct("label", F.lit(True).alias("f")).alias("label"))
        rest = labels.join(behind, "id", "left_anti").select("id", F.struct("label", F.lit(False).alias("f")).alias("label"))
        parts = stored(inside.union(rest), "parts")
        names = parts.groupBy("label").agg(F.min("id").alias("name"))
        labels, left = counted(parts.join(names, "label").select("id", F.col("name").alias("label")), "labels")
    whole = found[0] if found else labels.select("id", F.col("id").alias("comp"))
    for x in found[1:]:
        whole = whole.union(x)
    return terminal_named(whole, small)


def terminal_members(graph: Graph, decode: Column | None = None) -> DataFrame:
    """(comp, id, name) of the members of terminal components; decode turns an id into a name."""
    return terminal_by_colour(graph).select("comp", "id", (F.col("id").cast("string") if decode is None else decode).alias("name"))
