import random

import pytest

from vertexloom.graph import Graph
from vertexloom.operators import components as C
from vertexloom.operators import iterate, traversal
from vertexloom.sources import generators as g


def brute(n, edges):
    reach = [{i} for i in range(n)]
    out = [set() for _ in range(n)]
    for a, b in edges:
        out[a].add(b)
    for i in range(n):
        todo = [i]
        while todo:
            for y in out[todo.pop()]:
                if y not in reach[i]:
                    reach[i].add(y)
                    todo.append(y)
    return {i: min(j for j in reach[i] if i in reach[j]) for i in range(n)}


def graph_of(spark, n, edges):
    return Graph(spark.range(n).select("id"), spark.createDataFrame(edges or [], "src long, dst long")).materialized()


def pairs(df, *cols):
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


WAYS = {
    "steps": lambda x: C.strong_components(x, finish=0),
    "finished": lambda x: C.strong_components(x),
    "few left": lambda x: C.strong_components(x, finish=12),
    "both ways": lambda x: C.strong_components_fb(x, finish=0),
    "candidates": lambda x: C.strong_components_fb(x, finish=0, candidates=True),
    "slices": lambda x: C.strong_components_obf(x, finish=0),
    "random slices": lambda x: C.strong_components_obf(x, finish=0, random_pivots=True, nesting=2),
}


@pytest.mark.parametrize("way", list(WAYS))
def test_components_against_brute_force(spark, way):
    r = random.Random(len(way))
    n, m = r.choice([(16, 22), (20, 24), (12, 22)])
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    assert pairs(WAYS[way](graph_of(spark, n, edges)), "id", "comp") == set(brute(n, edges).items())


def test_depth_first_search():
    for seed in range(60):
        r = random.Random(seed)
        n = r.randint(1, 25)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 50))]
        want = brute(n, edges)
        assert dict(C.depth_first(*map(list, zip(*edges)))) == {i: want[i] for e in edges for i in e} if edges else True


@pytest.mark.parametrize("seed", [1])
def test_quotient_and_terminal_parts(spark, seed):
    r = random.Random(seed)
    n = 20
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(27)]
    want, graph = brute(n, edges), graph_of(spark, n, edges)
    comps = C.strong_components(graph)
    quotient = C.quotient(graph, comps)
    links = {(want[a], want[b]) for a, b in edges if want[a] != want[b]}
    assert pairs(quotient, "src_comp", "dst_comp") == links
    terminal = set(want.values()) - {a for a, _ in links}
    assert pairs(C.terminal_components(comps, quotient), "comp") == {(x,) for x in terminal}
    members = {(i, c) for i, c in want.items() if c in terminal}
    assert pairs(C.terminal_by_colour(graph), "id", "comp") == members
    assert pairs(C.terminal_by_reach(graph), "id", "comp") == members == pairs(C.terminal_by_reach(graph, trimmed=False), "id", "comp")
    depth = {c: 0 for c in terminal}
    while len(depth) < len(set(want.values())):
        for c in set(want.values()) - set(depth):
            ahead = [b for a, b in links if a == c]
            if all(b in depth for b in ahead):
                depth[c] = 1 + min(depth[b] for b in ahead)
    for finish in (0, 1000):
        assert pairs(C.quotient_depths(comps, quotient, finish), "comp", "depth") == set(depth.items())


def test_no_edges_no_vertices_and_nulls(spark):
    for way in (WAYS["steps"], WAYS["candidates"], WAYS["slices"]):
        assert pairs(way(graph_of(spark, 3, [])), "id", "comp") == {(0, 0), (1, 1), (2, 2)}
        assert way(graph_of(spark, 0, [])).count() == 0
    holes = Graph(spark.createDataFrame([(None,), (1,), (2,)], "id long"), spark.createDataFrame([(1, None), (None, 2), (1, 2), (2, 1), (None, None)], "src long, dst long"))
    assert pairs(C.strong_components(holes, finish=0), "id", "comp") == {(1, 1), (2, 1)}
    assert pairs(C.terminal_by_colour(holes), "id", "comp") == {(1, 1), (2, 1)} == pairs(C.terminal_by_reach(holes), "id", "comp")


@pytest.mark.parametrize(("make", "sizes", "terminal"), [(lambda s: g.lmlmtn(s, 3, 2), {9: 7}, 4), (lambda s: g.line_of(s, 4, g.clique(s, 5)), {5: 4}, 1), (lambda s: g.ring(s, 20), {20: 1}, 1)])
def test_known_shapes(spark, make, sizes, terminal):
    graph = make(spark).materialized()
    comps = C.strong_components(graph, finish=0)
    assert {x.size: x.n for x in C.size_histogram(comps).collect()} == sizes
    assert C.terminal_components(comps, C.quotient(graph, comps)).count() == terminal


def test_depths(spark):
    graph = g.line_of(spark, 4, g.clique(spark, 5)).materialized()
    comps = C.strong_components(graph)
    cyclic = spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src_comp long, dst_comp long")
    for finish in (0, 100):
        depths = C.quotient_depths(comps, C.quotient(graph, comps), finish)
        assert sorted(x.depth for x in depths.collect()) == [0, 1, 2, 3]
        with pytest.raises(ValueError, match="cycle"):
            C.quotient_depths(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, comp long"), cyclic, finish)


def test_heavy_sources_are_dealt_out(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 90)] + [(i, 0) for i in range(1, 90)] + [(90, 91)], "src long, dst long")
    with iterate.placed(edges, heavy=10) as near:
        assert near.heavy.collect()[0] == (0, 9) and near.kept.filter("src = 0").select("slot").distinct().count() > 4
        rows = spark.createDataFrame([(0, "a"), (5, "b"), (90, "c"), (7000, "d")], "id long, v string")
        assert pairs(near.follow(rows), "v", "dst") == {("a", i) for i in range(1, 90)} | {("b", 0), ("c", 91)}


def test_merging_structures(spark):
    a = spark.createDataFrame([(1, 10), (2, 30)], "comp long, size long")
    b = spark.createDataFrame([(2, 30), (3, 20)], "comp long, size long")
    assert sorted(tuple(x) for x in C.merge_components(a, b).collect()) == [(1, 10), (2, 30), (3, 20)]
    with pytest.raises(Exception, match="two sizes"):
        C.merge_components(a, b.withColumn("size", b["size"] + 1)).collect()


def chained(seed):
    """A small random graph, its edges drawn out to chains, and a ring beside it; ids in no order."""
    r = random.Random(seed)
    edges, n = [], 8
    for a, b in [(r.randrange(8), r.randrange(8)) for _ in range(10)]:
        for _ in range(r.randint(0, 3)):
            edges.append((a, n))
            a, n = n, n + 1
        edges.append((a, b))
    edges += [(n, n + 1), (n + 1, n + 2), (n + 2, n)]
    names = r.sample(range(n + 3), n + 3)
    return n + 3, [(names[a], names[b]) for a, b in edges]


@pytest.mark.parametrize("block", [6, 1000])
def test_contraction_against_brute_force(spark, block):
    n, edges = chained(block)
    want, graph = brute(n, edges), graph_of(spark, n, edges)
    assert pairs(C.strong_components(graph, finish=1, block=block), "id", "comp") == set(want.items())
    leaving = {want[a] for a, b in edges if want[a] != want[b]}
    members = {(i, c) for i, c in want.items() if c not in leaving}
    assert pairs(C.terminal_by_colour(graph, few=0, block=block), "id", "comp") == members == pairs(C.terminal_by_reach(graph, few=0, block=block), "id", "comp")


def test_long_chains_take_few_rounds(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n - 1)] + [(100, 0), (200, 150), (299, 250)]
    graph = graph_of(spark, n, edges)
    iterate.LOG.clear()
    comps = C.strong_components_fb(graph, finish=0)
    assert {x.size: x.n for x in C.size_histogram(comps).collect()} == {101: 1, 51: 1, 50: 1, 1: 98}
    assert len(iterate.LOG) < 30  # one reach alone took a hundred


@pytest.mark.parametrize("block", [7, 40, 1000])
def test_depths_over_ranges(spark, block):
    r = random.Random(block)
    n = 120
    names = r.sample(range(1000), n) if block == 40 else list(range(n))
    edges = sorted({(i, i + 1) for i in range(n - 1) if i % 17} | {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(60)) if a < b})
    comps = spark.createDataFrame([(x,) for x in names], "comp long")
    quotient = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "src_comp long, dst_comp long")
    want: dict[int, int] = {}
    for v in range(n - 1, -1, -1):
        want[v] = min((want[b] + 1 for a, b in edges if a == v), default=0)
    iterate.LOG.clear()
    assert pairs(C.quotient_depths(comps, quotient, finish=0, block=block), "comp", "depth") == {(names[v], k) for v, k in want.items()}
    if block == 1000:
        assert len(iterate.LOG) == 1  # a round for every vertex of the longest path before
    with pytest.raises(ValueError, match="cycle"):
        C.quotient_depths(comps, quotient.union(spark.createDataFrame([(names[50], names[40])], "src_comp long, dst_comp long")), finish=0, block=block)


@pytest.mark.parametrize("block", [50, 1000])
def test_terminal_searches_over_ranges(spark, block):
    n = 120
    edges = [(i, i + 1) for i in range(99) if i % 10] + [(i, i + 20) for i in range(0, 80, 3)] + [(100 + i, 100 + (i ^ 1)) for i in range(20)]
    want, graph = brute(n, edges), graph_of(spark, n, edges)
    leaving = {want[a] for a, b in edges if want[a] != want[b]}
    members = {(i, c) for i, c in want.items() if c not in leaving}
    for trimmed in (True, False):
        iterate.LOG.clear()
        found = C.terminal_by_reach(graph, trimmed, few=1000, block=block)
        assert pairs(found, "id", "comp") == members
        assert not iterate.LOG  # a pivot for each of twenty components before
    assert pairs(C.terminal_by_colour(graph, few=1000, block=block, finish=0), "id", "comp") == members == pairs(C.terminal_by_colour(graph, few=1000, block=block), "id", "comp")
    far = C.reach_set(graph.edges, spark.createDataFrame([(51,), (100,)], "id long"), block=block)
    assert pairs(far, "id") == pairs(traversal.reach_set(graph.edges, spark.createDataFrame([(51,), (100,)], "id long")), "id")
    assert pairs(C.terminal_by_reach(graph_of(spark, 40, [(i, i + 1) for i in range(29)]), False, few=1000, block=7, finish=0), "id", "comp") == {(i, i) for i in range(29, 40)}


@pytest.mark.parametrize("block", [20, 1000])
def test_trimming_takes_whole_paths(spark, block):
    r = random.Random(block)
    n = 150
    edges = sorted({(i, i + 1) for i in range(n - 1) if i % 50} | {(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(30)) if a < b} | {(90, 70), (70, 60), (60, 70)})
    left = set(edges)
    while True:  # the slow way
        kept = {e for e in left if e[0] in {b for _, b in left} and e[1] in {a for a, _ in left}}
        if kept == left:
            break
        left = kept
    found, rows = C.trim(spark.createDataFrame(edges, "src long, dst long"), len(edges), block=block)
    assert left and pairs(found, "src", "dst") == left and rows == len(left)  # nine steps from either end before


def test_slices_go_along_paths_at_once(spark):
    n = 100
    edges = [(i, i + 1) for i in range(n - 1)] + [(i, i + 2) for i in range(n - 2)] + [(99, 95), (98, 96)]
    iterate.LOG.clear()
    found = C.strong_components_obf(graph_of(spark, n, edges), finish=1)
    assert pairs(found, "id", "comp") == set(brute(n, edges).items())
    assert len(iterate.LOG) < 12


def test_chains_over_many_ranges_go_first(spark):
    """Every edge of a path leads into another range of ids; trimming took a round for each."""
    n = 300
    name = lambda i: i % 30 * 10 + i // 30
    edges = [(name(i), name(i + 1)) for i in range(n - 1)] + [(name(200), name(100))]
    graph = graph_of(spark, n, edges)
    iterate.LOG.clear()
    comps = C.strong_components(graph, finish=10, block=20)
    assert {x.size: x.n for x in C.size_histogram(comps).collect()} == {101: 1, 1: 199}
    assert len(iterate.LOG) < 5
    assert C.quotient(graph, comps).count() == 199


def test_joins_of_the_contraction_pass_the_driver_by(spark):
    n, edges = chained(3)
    graph = graph_of(spark, n, edges)
    plan = C.quotient(graph, C.strong_components(graph))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most", ["3", "10000"])
def test_ranges_make_repeated_edges_distinct(spark, most):
    from vertexloom.operators.contract import Ranges

    r = random.Random(int(most))
    n = 40
    edges = [e for e in ((r.randrange(n), r.randrange(n)) for _ in range(90)) if e[0] != e[1]] + [(7, x) for x in range(8, 40)]
    many = [e for e in edges for _ in range(r.randint(1, 9))]
    want = brute(n, edges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        for block in (20, 60):
            level = Ranges(spark.createDataFrame(many, "src long, dst long"), len(many), block, C.depth_first, once=False)
            found = pairs(level.edges, "src", "dst")
            to = {x.id: x.to for x in level.places.collect()}
            assert found == {(to.get(a, a), to.get(b, b)) for a, b in edges if to.get(a, a) != to.get(b, b)} and level.rows == len(found)
            assert all(want[i] == want[t] for i, t in to.items())
        alone = Ranges(spark.createDataFrame([(1, 2), (1, 2), (2, 3)], "src long, dst long"), 3, 2, C.depth_first, once=False)
        assert not alone.found and pairs(alone.edges, "src", "dst") == {(1, 2), (2, 3)} and alone.rows == 2
        graph = Graph.of_edges(spark.createDataFrame(many, "src long, dst long")).materialized()
        leaving = {want[a] for a, b in edges if want[a] != want[b]}
        ends = {x for e in edges for x in e}
        assert pairs(C.terminal_by_colour(graph, few=5, block=20), "id", "comp") == {(i, c) for i, c in want.items() if i in ends and c not in leaving}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
