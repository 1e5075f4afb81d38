import random

import pytest

from vertexloom.operators import iterate, traversal
from vertexloom.operators.reach import reached


@pytest.mark.parametrize("seed, few, block", [(1, 0, 9), (2, 0, 1000), (4, 5, 30)])
def test_reach_over_contracted_graphs(spark, seed, few, block):
    r = random.Random(seed)
    names = r.sample(range(200), 120) if seed % 2 else list(range(120))
    edges = [(i, i + 1) for i in range(119) if i % 13] + [(r.randrange(120), r.randrange(120)) for _ in range(25)] + [(130, 131), (131, 132), (132, 130)]
    edges = [tuple(names[x] if x < 120 else 1000 + x for x in e) for e in edges]
    rows = spark.createDataFrame([*edges, *edges[:9], (edges[0][0], None), (None, edges[1][1])], "src long, dst long")
    sources = r.sample(names, seed) + [5000]
    want, todo = set(sources), list(sources)
    while todo:
        v = todo.pop()
        new = {b for a, b in edges if a == v} - want
        want |= new
        todo += new
    got = reached(rows, spark.createDataFrame([(x,) for x in sources] + [(None,)], "id long"), few, block)
    assert sorted(x.id for x in got.collect()) == sorted(want)


def test_cascades_take_few_rounds_on_long_ways(spark):
    n = 120
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(i + 1, i) for i in range(n)], "src long, dst long")
    graph = traversal.Graph.of_edges(edges)
    iterate.LOG.clear()
    assert traversal.cascade(graph, spark.createDataFrame([(0,)], "id long"), p=1.0).count() == n + 1
    assert len(iterate.LOG) <= 2  # a round for every three edges before
