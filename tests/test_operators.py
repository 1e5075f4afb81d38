import pytest
from pyspark.sql import functions as F

from vertexloom.functions import scalar
from vertexloom.functions.index import with_row_number
from vertexloom.graph import Graph
from vertexloom.operators import collectives, degrees, iterate, pregel, rank, search, traversal, triangles
from vertexloom.sources import generators as g


def of(spark, edges, root=None):
    return Graph.of_edges(spark.createDataFrame(edges, "src long, dst long"), root)


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hops_on_shapes(spark, monkeypatch):
    monkeypatch.setattr(iterate.Layers, "MOST", 4)
    assert pairs(traversal.hop_distance(g.line(spark, 22), 0), "id", "dist") == [(i, i) for i in range(22)]  # more rounds than tables are kept apart
    assert max(d for _, d in pairs(traversal.hop_distance(g.biring(spark, 7), 0), "id", "dist")) == 3
    got = dict(pairs(traversal.hop_distance(of(spark, [(1, 2), (3, 1)], 1)), "id", "dist"))
    assert got == {1: 0, 2: 1, 3: None}


def test_search_tree_and_echo_sums(spark):
    graph = of(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (9, 0), (4, 4), (0, 2)])
    tree = traversal.search_tree(graph, 0)
    assert pairs(tree, "id", "dist", "father") == sorted([(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1), (4, 3, 3)], key=str)
    assert pairs(traversal.echo_sizes(tree), "id", "size") == [(0, 5), (1, 3), (2, 1), (3, 2), (4, 1)]
    assert dict(pairs(traversal.to_father(tree, graph.out_degrees(), "degree"), "id", "degree")) == {0: None, 1: 3, 2: 3, 3: 1, 4: 1}
    assert pairs(traversal.echo_sizes(tree.limit(0)), "id") == []


def test_spread_takes_long_ways(spark):
    line = g.line(spark, 30)
    labels = line.vertices.select("id", F.col("id").alias("label"))
    assert {x for _, x in pairs(traversal.spread(labels, line.edges, largest=False), "id", "label")} == {0}
    assert {x for _, x in pairs(traversal.spread(labels, line.transpose().edges), "id", "label")} == {29}


def test_empty_graphs_and_null_ends(spark):
    none = of(spark, [])
    assert none.vertices.count() == none.out_degrees().count() == traversal.hop_distance(none).count() == traversal.search_tree(none).count() == 0
    assert tuple(none.info().first()) == (0, 0, None, 0, 0)
    assert tuple(traversal.visit_all(none).first()) == (0, 1) and traversal.echo(none).first().echoes == 0
    assert rank.pagerank(none, 2).count() == 0 and rank.pagerank_converged(none)[1] == 0 and triangles.triangle_counts(none).count() == 0
    assert degrees.degree_histogram(none).count() == 0 and traversal.bfs_summary(none).first().visited == 0
    holes = of(spark, [(1, 2), (None, 2), (2, None), (None, None), (2, 3), (3, 1), (1, 2)])
    assert pairs(holes.vertices, "id") == [(1,), (2,), (3,)]
    assert pairs(traversal.hop_distance(holes, 1), "id", "dist") == [(1, 0), (2, 1), (3, 2)]
    assert pairs(holes.out_degrees(), "id", "degree") == [(1, 2), (2, 2), (3, 1)]
    assert pairs(triangles.triangle_counts(holes), "id", "n") == [(1, 1), (2, 1), (3, 1)]
    assert sum(r for _, r in pairs(rank.pagerank(holes, 3), "id", "rank")) == pytest.approx(3)
    wide = Graph(holes.vertices.withColumn("label", F.lit(1)), holes.edges.withColumn("dist", F.lit(9)).withColumn("id", F.lit(1)), 1)
    assert pairs(traversal.hop_distance(wide), "id", "dist") == [(1, 0), (2, 1), (3, 2)] and traversal.visit_all(wide).first().visited == 3


def test_visits(spark):
    graph = of(spark, [(0, 1), (0, 1), (1, 2), (3, 0), (4, 4)])
    assert tuple(traversal.visit_count(graph, 0).first()) == (3, 4)
    assert tuple(traversal.visit_all(graph).first()) == (5, 4)  # pivots 0, 3, 4 and the round without one
    assert traversal.echo(graph, 0).first().echoes == 4


def test_cascade_extremes(spark):
    graph = g.ring(spark, 10)
    seeds = spark.createDataFrame([(3,)], "id long")
    assert traversal.cascade(graph, seeds, p=1.1).count() == 10
    assert traversal.cascade(graph, seeds, p=0.0).count() == 0
    assert traversal.cascade_seeds(graph, 4).count() == 4


def test_pagerank_stops(spark):
    ranks, rounds = rank.pagerank_converged(g.ring(spark, 10))
    assert rounds == 1 and all(abs(r.rank - 0.1) < 1e-12 for r in ranks.collect())
    graph = of(spark, [(i, i * i % 31) for i in range(31)] + [(i, i * 3 % 31) for i in range(31)])
    (a, x), (b, y) = rank.pagerank_converged(graph, 1e-4, at_once=1), rank.pagerank_converged(graph, 1e-4, at_once=5)
    assert x == y and x > 5 and dict(pairs(a, "id", "rank")) == pytest.approx(dict(pairs(b, "id", "rank")))
    with pytest.raises(RuntimeError, match="settle"):
        rank.pagerank_converged(graph, 1e-12, max_rounds=3)
    assert abs(rank.pagerank(g.ring(spark, 5), 3).agg(F.sum("rank")).first()[0] - 5) < 1e-9
    lossy = dict(pairs(rank.pagerank(of(spark, [(0, 1), (0, 1), (0, 2)]), 1), "id", "rank"))
    assert abs(lossy[1] - (0.15 + 0.85 * 2 / 3)) < 1e-12 and abs(lossy[0] - 0.15) < 1e-12


def test_triangles(spark):
    graph = of(spark, [(0, 1), (1, 2), (2, 0), (2, 0), (1, 0), (0, 2), (2, 1), (3, 3)])
    assert dict(pairs(triangles.triangle_counts(graph), "id", "n")) == {0: 2, 1: 2, 2: 2}
    assert pairs(triangles.top_triangles(graph, 4), "id", "n") == [(0, 2), (1, 2), (2, 2), (3, 0)]
    assert set(dict(pairs(triangles.triangle_counts(g.clique(spark, 6)), "id", "n")).values()) == {20}


def test_histograms(spark):
    values = spark.createDataFrame([(20000, 110), (20000, 20), (20001, 20)], "value long, n long")
    hist = degrees.histogram_of(values, "value", "n")
    assert pairs(hist, "value", "cnt") == [(20000, 130), (20001, 20)]
    assert pairs(degrees.merge_histograms(hist, hist), "value", "cnt") == [(20000, 260), (20001, 40)]
    with pytest.raises(Exception, match="negative"):
        degrees.histogram_of(spark.createDataFrame([(-1,)], "value long")).collect()
    assert degrees.histogram_statistics(spark.createDataFrame([(5, 1)], "degree long, cnt long")).first().stdev == 0


def test_messages_and_loops(spark):
    graph = g.line(spark, 6)
    state = graph.vertices.select("id", F.col("id").alias("top"))
    got = pregel.pregel(state, graph.transpose().edges, F.col("top"), F.max("msg"), {"top": F.greatest("top", "merged")}, 5)
    assert {t for _, t in pairs(got, "id", "top")} == {5}
    out, rounds = iterate.fixpoint(spark.createDataFrame([(40,)], "x long"), lambda s, k: s.select(F.floor(F.col("x") / 2).alias("x")), lambda a, b: b.first().x > 0)
    assert (out.first().x, rounds) == (0, 6)

    def stop(s, k):
        raise iterate.StopRequested

    assert iterate.fixpoint(state, stop, lambda a, b: True)[1] == 0
    with pytest.raises(RuntimeError):
        iterate.fixpoint(state, lambda s, k: s, lambda a, b: True, max_rounds=2)


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 100, i) for i in range(100)], "k long, v long").repartition(5)
    assert [r.row for r in with_row_number(df, "k").orderBy("k").collect()] == list(range(100))


def test_scalars(spark):
    df = spark.createDataFrame([(3, 5), (-1, -1)], "owner int, local int")
    got = df.select(scalar.reference_name(F.col("owner"), F.col("local")).alias("n"), scalar.pack_reference(F.col("owner"), F.col("local")).alias("p")).collect()
    assert [r.n for r in got] == ["5@3", "nullnode"]
    back = spark.createDataFrame([(r.p,) for r in got], "p long").select(scalar.reference_owner(F.col("p")), scalar.reference_local(F.col("p"))).collect()
    assert [tuple(r) for r in back] == [(3, 5), (-1, -1)]
    digits = spark.range(1).select(scalar.encode_radix(F.array(F.lit(2), F.lit(0), F.lit(1)), 3).alias("x")).first().x
    assert digits == 11
    assert spark.range(1).select(scalar.decode_radix(F.lit(11), 3, 3).alias("x")).first().x == [2, 0, 1]
    assert spark.range(1).select(scalar.size_colour(F.lit(10), F.lit(10)).alias("c")).first().c == "#ff4000"
    draws = spark.range(20000).select(scalar.uniform(1, "id").alias("u"), scalar.normal(1, "id").alias("z")).agg(F.avg("u"), F.stddev("z"), F.min("u"), F.max("u")).first()
    assert abs(draws[0] - 0.5) < 0.01 and abs(draws[1] - 1) < 0.02 and draws[2] >= 0 and draws[3] < 1


def test_search(spark):
    def counters(state):
        a, b = state
        if (a, b) == (2, 1):
            raise RuntimeError("no such move")
        return [bytes(x) for x in ((a + 1, b), (a, b + 1)) if max(x) < 3]

    found = search.explore(spark, [bytes((0, 0))], counters)
    assert found.states.count() == 9 and found.complete
    assert [r.error for r in found.errors.collect()] == ["RuntimeError: no such move"]
    assert [bytes(r.state) for r in found.deadlocks().collect()] == [bytes((2, 2))]
    assert found.deadlocks(lambda s: sum(s) == 4).count() == 0
    shallow = search.explore(spark, [bytes((0, 0))], counters, max_depth=2)
    assert not shallow.complete and shallow.states.count() == 6
    assert not search.explore(spark, [bytes((0, 0))], counters, max_errors=1).complete
    passing = search.explore(spark, [bytes((0, 0))], counters, store=lambda s: sum(s) % 2 == 0)
    assert {sum(r.state) % 2 for r in passing.states.collect()} == {0}


def test_custom_reductions_merge_in_a_tree(spark):
    df = spark.range(1000).repartition(9)
    got = collectives.reduce_custom(df, (0, frozenset()), lambda p, r: (p[0] + r["id"], p[1] | {r["id"] % 7}), lambda a, b: (a[0] + b[0], a[1] | b[1]), fan=3)
    assert got == (499500, frozenset(range(7)))
    assert collectives.reduce_custom(spark.range(0), 5, lambda p, r: p + 1, lambda a, b: max(a, b)) == 5


def test_checker_options(spark):
    def steps(state):
        (x,) = state
        if x == 3:
            raise AssertionError("three")
        if x == 5:
            raise ValueError("five")
        return {0: [b"\1", b"\3"], 1: [b"\2", b"\5"], 2: [b"\1", b"\4"]}.get(x, [])

    def kinds(**options):
        found = search.check(spark, [b"\0"], steps, max_errors=0, **options)
        return sorted((r.kind, bytes(r.state)) for r in found.errors.collect()), found

    got, found = kinds()
    assert got == [("assertion", b"\3"), ("exception", b"\5"), ("invalid end state", b"\4")]
    assert found.report.first().complete and found.report.first().stored == 6 and found.report.first().transitions == 6
    assert kinds(deadlocks=False, asserts=False)[0] == [] == kinds(is_end=lambda s: True, asserts=False)[0]
    assert kinds(deadlocks=False, asserts=False, accepting=lambda s: s == b"\2")[0] == [("acceptance cycle", b"\2")]
    assert kinds(deadlocks=False, asserts=False, claim=lambda s: s != b"\1")[0] == [("claim", b"\1")]
    got, found = kinds(max_depth=1, depth_is_error=True, asserts=False)
    assert got == [("depth limit", b"\1"), ("depth limit", b"\3")] and not found.report.first().complete
    assert not search.check(spark, [b"\0"], steps, max_errors=1).exploration.complete


def test_loop_is_an_accepting_cycle(spark):
    found = search.explore(spark, [b"a"], lambda s: {b"a": [b"b"], b"b": [b"b", b"c"]}.get(s, []))
    assert [bytes(r.state) for r in found.accepting_cycle_states(lambda s: True).collect()] == [b"b"]
