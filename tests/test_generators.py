from collections import Counter

import pytest

from vertexloom.sources import generators as g
from vertexloom.sources import spec


def edges(graph):
    return sorted((r.src, r.dst) for r in graph.edges.collect())


def test_small_shapes(spark):
    assert edges(g.line(spark, 1)) == []
    assert edges(g.ring(spark, 1)) == [(0, 0)]
    assert edges(g.biring(spark, 1)) == [(0, 0), (0, 0)]
    assert edges(g.biring(spark, 2)) == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert edges(g.clique(spark, 1)) == []
    assert edges(g.clique(spark, 3)) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert edges(g.tree(spark, 2, 2)) == [(0, 1), (0, 4), (1, 2), (1, 3), (4, 5), (4, 6)]
    assert edges(g.tree(spark, 0, 2)) == []
    got = edges(g.lattice(spark, 3, 4, True, False))
    assert {(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (4, 8)} <= set(got) and (8, 0) not in got


@pytest.mark.parametrize(("name", "text", "vertices", "count"), [("LmLmTn", "3:3", 135, 396), ("LimLon", "3:4", 144, 480), ("TreeOfRings", "2:5", 35, 41), ("LineOfCliques", "4:5", 20, 83), ("LatticeLooped", "6:5", 30, 60), ("Lattice", "6:5", 30, 49)])
def test_sizes(spark, name, text, vertices, count):
    graph = spec.load_graph(spark, name, text)
    assert (graph.vertices.count(), graph.edges.count()) == (vertices, count)


@pytest.mark.parametrize(("name", "text"), [("Line", "0"), ("Tree", "-1:2"), ("Tree", "2:1"), ("Lattice", "0:3"), ("Clique", "0"), ("Line", "1:2"), ("Line", "x"), ("NoSuchThing", "1"), ("SlowErdos", "0:1:1")])
def test_bad_specifications(spark, name, text):
    with pytest.raises((g.GraphSpecError, ZeroDivisionError)):
        spec.load_graph(spark, name, text)


def test_specification_fields():
    assert spec.cut("::a::b:") == ["a", "b"]
    assert len(spec.names()) == len(set(spec.names())) > 65


def test_compat_swaps(spark):
    a, b = (spec.load_graph(spark, "LatticeLooped", "2:3", compat=c) for c in (False, True))
    assert a.vertices.count() == b.vertices.count() and edges(a) != edges(b)


def test_random_shapes_do_not_hang_on_layout(spark):
    a = edges(spec.load_graph(spark, "LogN", "200:1.5:0.8:7"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert edges(spec.load_graph(spark, "LogN", "200:1.5:0.8:7")) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert edges(spec.load_graph(spark, "LogN", "200:1.5:0.8:8")) != a


def test_slow_erdos_density(spark):
    graph = g.slow_erdos(spark, 100, 0.5, 1)
    assert abs(graph.edges.count() - 5000) < 500
    assert graph.edges.distinct().count() == graph.edges.count()


def test_distinct_targets(spark):
    graph = g.degree_distribution(spark, 60, g.Degrees("discrete", 20, 80), 3, distinct=True)
    got = edges(graph)
    assert len(got) == len(set(got))
    most = Counter(s for s, _ in got)
    assert max(most.values()) == 60 and min(most.values()) >= 20
    assert all(0 <= t < 60 for _, t in got)


@pytest.mark.parametrize(("law", "mean"), [(g.Degrees("binomial", 100, 0.1), 10), (g.Degrees("normal", 20, 3), 20), (g.Degrees("uniform", 2, 6), 4), (g.Degrees("pareto", 2, 3), 3), (g.Degrees("power", 50, -2.5), 2.4)])
def test_mean_degree(spark, law, mean):
    n = 3000
    assert abs(g.degree_distribution(spark, n, law, 5).edges.count() / n - mean) < 0.1 * mean + 0.3


def test_binomial_law_is_exact(spark):
    """Counts of 40,000 draws against the law, also beyond 64 trials and at its ends."""
    import math

    from pyspark.sql import functions as F

    from vertexloom.functions import scalar

    for n, p in ((1000, 0.008), (50, 0.3), (200, 0.99), (1, 0.5)):
        got = {r[0]: r[1] for r in spark.range(40_000).select(scalar.binomial(n, p, 3, "id").alias("x")).groupBy("x").count().collect()}
        for k in range(n + 1):
            want = 40_000 * math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert abs(got.get(k, 0) - want) < 5 * math.sqrt(want) + 4, (n, k)
    least, steps = scalar.binomial_steps(1000, 0.008)
    assert least == 0 and abs(steps[0] - 0.992**1000) < 1e-12 and steps[-1] == 1.0
    ends = spark.range(3).select(scalar.binomial(7, 0.0, 1, "id").alias("a"), scalar.binomial(7, 1.0, 1, "id").alias("b"), scalar.binomial(0, 0.5, 1, "id").alias("c")).distinct().collect()
    assert [tuple(r) for r in ends] == [(0, 7, 0)]
    assert spark.range(5).select(F.max(scalar.binomial_by_normal(10, 0.5, 1, "id"))).first()[0] <= 10


def test_laws_without_a_degree_in_range(spark):
    with pytest.raises(Exception, match="no degree in range"):
        g.degree_distribution(spark, 5, g.Degrees("uniform", -9, -5), 1).edges.count()


def test_targets_of_dense_sources_are_uniform(spark):
    """Sources that want most of few vertices: no target is preferred."""
    graph = g.degree_distribution(spark, 40, g.Degrees("discrete", 30, 30), 3, distinct=True)
    hits = Counter(t for _, t in edges(graph))
    assert sum(hits.values()) == 1200 and min(hits.values()) > 15 and max(hits.values()) <= 40


def test_many_copies_are_dealt_out(spark):
    graph = g.line_of(spark, 10_000, g.ring(spark, 3))
    assert graph.edges.count() == 39_999 and graph.edges.distinct().count() == 39_999
    assert graph.edges.rdd.getNumPartitions() >= 3


def test_trees_at_random(spark):
    assert edges(g.randomized_tree(spark, 1, 3)) == [] and edges(g.randomized_tree(spark, 2, 3)) == [(0, 1)]
    assert edges(g.randomized_tree(spark, 60, 3, levels=1)) == edges(g.randomized_tree(spark, 60, 3))
    graph = spec.load_graph(spark, "RandomizedTree", "200:3")
    got = edges(graph)
    assert len(got) == 199 and sorted(t for _, t in got) == list(range(1, 200))
    assert max(Counter(s for s, _ in got).values()) <= 2


def test_shortcuts(spark):
    got = edges(spec.load_graph(spark, "RingWithShortcuts", "50:2"))
    assert len(got) == 150 and {(i, (i + 1) % 50) for i in range(50)} <= set(got)


def test_ordered_tree_points_both_ways(spark):
    got = edges(g.ordered_tree(spark, 1, 2))
    assert [e for e in got if e[0] != e[1]] == [(0, 1), (1, 2), (3, 1), (4, 0), (4, 5), (6, 4)]
    assert edges(g.rooted_tree(spark, 1, 1)) == [(0, 1), (0, 2)]
