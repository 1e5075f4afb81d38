import itertools
import random

import pytest

from vertexloom.graph import Graph
from vertexloom.operators import components as C
from vertexloom.sources import segments as S
from vertexloom.sources import sinks, spec
from vertexloom.sources.petri import PetriNet


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize(("form", "compact", "policy"), [("svcii", False, "round"), ("hip", False, "random"), ("hip", True, "round")])
def test_round_trip_with_multiplicity(spark, tmp_path, form, compact, policy):
    r = random.Random(4)
    edges = [(r.randrange(20) * 3, r.randrange(20) * 3) for _ in range(80)] + [(0, 3)] * 4
    graph = Graph(spark.createDataFrame([(3 * i,) for i in range(25)], "id long"), spark.createDataFrame(edges, "src long, dst long"), 6)
    path = str(tmp_path / "g")
    places = S.write_graph(graph, path, form, segments=3, compact=compact, policy=policy, colocated=2)
    head = S.read_header(path, form)
    assert head.segments == 3 and sum(head.sizes) == 25
    got = spec.load_graph(spark, form, path)
    names = {head.bases()[p.segment] + p.offset: p.id for p in places.collect()}
    assert sorted(names) == list(range(25)) and names[got.root] == 6
    assert sorted((names[a], names[b]) for a, b in rows(got.edges, "src", "dst")) == sorted(edges)
    assert head.describe(spark).agg({"edges_in": "sum", "edges_out": "sum"}).first() == (84, 84)


def test_labels(spark, tmp_path):
    graph = Graph(spark.range(4).select("id"), spark.createDataFrame([(0, 1, 5), (1, 2, 7), (3, 0, 5)], "src long, dst long, label int"), 0)
    S.write_graph(graph, str(tmp_path / "g"), "svcii", segments=1)
    assert rows(S.read_graph(spark, str(tmp_path / "g"), "svcii").edges, "src", "dst", "label") == [(0, 1, 5), (1, 2, 7), (3, 0, 5)]


def test_bad_headers(tmp_path):
    with pytest.raises(S.GraphFormatError, match="version"):
        S.Header.of_svcii(b"\0\0\0\x05")
    with pytest.raises(S.GraphFormatError, match="magic"):
        S.Header.of_hip(b"\0\0\0\x05")
    with pytest.raises(S.GraphFormatError, match="ends"):
        S.Header.of_hip(S.Header([1], [[0]], forms=[0]).to_hip()[:-4])


def test_segment_owners_are_blocks():
    for segments, workers in ((10, 3), (7, 7), (9, 4), (3, 2)):
        owners = [S.segment_owner(s, segments, workers) for s in range(segments)]
        assert owners == sorted(owners) and set(owners) == set(range(workers))


def fire(net, rules, state):
    out = set()
    for inputs, kind, outputs in rules:
        if any((state[p] > 0) if inhibits else (state[p] == 0) for p, inhibits in inputs):
            continue
        new = list(state)
        if not net.biological:
            if any((state[p] - 1 < 0) if kind == "|" else (state[p] + 1 > net.largest) for p in outputs):
                continue
            for p, inhibits in inputs:
                if not inhibits:
                    new[p] = new[p] - (0 if net.compat else 1) + (1 if net.compat and new[p] < net.largest else 0)
        for p in outputs:
            new[p] = max(0, new[p] - 1) if kind == "|" else min(net.largest, new[p] + 1)
        out.add(tuple(new))
    if net.biological:
        for p in range(len(net.places)):
            fed = [all((state[q] == 0) if i else (state[q] > 0) for q, i in inputs) for inputs, kind, outputs in rules if p in outputs and kind == ">"]
            if state[p] > 0 and not any(fed):
                new = list(state)
                new[p] -= 1
                out.add(tuple(new))
        out.discard(tuple(state))
    return out


@pytest.mark.parametrize(("biological", "compat"), [(False, False), (True, False), (False, True)])
def test_petri_state_space(spark, biological, compat):
    net = PetriNet.parse(["a & ^b -> c", "c -> b & a", "b -| a"], 2, biological, compat)
    rules = [([(0, False), (1, True)], ">", [2]), ([(2, False)], ">", [1, 0]), ([(1, False)], "|", [0])]
    assert net.places == ["a", "b", "c"] and net.states == 27
    number = lambda s: sum(x * 3**i for i, x in enumerate(s))
    want = sorted((number(s), number(t)) for s in itertools.product(range(3), repeat=3) for t in fire(net, rules, s))
    assert rows(net.graph(spark).edges, "src", "dst") == want
    assert net.markings(spark.createDataFrame([(number((2, 0, 1)),)], "id long")).first().marking == "a=2 c=1"


def test_compat_reaches_the_net(spark, tmp_path):
    (tmp_path / "net").write_text("a & ^b -> c\nc -> b & a\nb -| a\n")
    plain, old = (rows(spec.load_graph(spark, "PetriNetStateSpace", f"2:{tmp_path}/net", compat=c).edges, "src", "dst") for c in (False, True))
    assert plain != old and old == rows(PetriNet.parse(["a & ^b -> c", "c -> b & a", "b -| a"], 2, compat=True).graph(spark).edges, "src", "dst")


def test_pieces_of_edge_files(spark, tmp_path, monkeypatch):
    """Files longer than a piece, and files that hold fewer or more numbers than the header says."""
    monkeypatch.setattr(S, "PIECE", 7)
    r = random.Random(1)
    edges = [(r.randrange(9), r.randrange(9)) for _ in range(100)]
    graph = Graph(spark.range(9).select("id"), spark.createDataFrame(edges, "src long, dst long"))
    for form, compact in (("hip", False), ("hip", True), ("svcii", False)):
        path = str(tmp_path / f"{form}{compact}")
        S.write_graph(graph, path, form, segments=1, compact=compact)
        assert rows(S.read_graph(spark, path, form).edges, "src", "dst") == sorted(edges)
    raw = S.raw_numbers(spark, path, "src-*")
    assert [x.value for x in raw.orderBy("at").collect()] == sorted(a for a, _ in edges)
    assert len(list(S.numbers_in_pieces(path, "src-0-0", 100))) == 15
    for n in (99, 101):
        with pytest.raises(S.GraphFormatError, match="header"):
            list(S.numbers_in_pieces(path, "src-0-0", n))
    with pytest.raises(S.GraphFormatError, match="header"):
        list(S.runs_in_pieces(str(tmp_path / "hipTrue"), "src-0", 99))


def test_maker_command(spark, tmp_path):
    from vertexloom.__main__ import main

    main(["Ring", "12", str(tmp_path / "g"), "--out", "svcii", "--segments", "2"], spark)
    assert spec.load_graph(spark, "svcii", str(tmp_path / "g")).edges.count() == 12
    with pytest.raises(SystemExit):
        main(["Ring"])


def test_petri_grammar():
    with pytest.raises(ValueError, match="line 2"):
        PetriNet.parse(["a -> b", "a => b"], 1)


def test_make_graph_and_dot(spark, tmp_path):
    spec.make_graph(spark, "LmLmBTn", "2:1", str(tmp_path / "g"), "svcii", 2)
    assert spec.load_graph(spark, "svcii", str(tmp_path / "g")).edges.count() == 3 * 8 + 2
    graph = Graph.of_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert [r.line for r in sinks.dot_lines(graph, transposed=True).collect()] == ['  2 -> 1 [color="red"];']
    sinks.write_dot(graph, str(tmp_path / "dot"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "dot").glob("part-*")))
    assert text.split("\n")[:3] == ["digraph g {", "  1 -> 2;", "}"]


def test_member_listing(spark, tmp_path):
    graph = Graph.of_edges(spark.createDataFrame([(1, 2), (2, 1), (0, 1), (0, 5)], "src long, dst long"))
    sinks.write_members(C.terminal_members(graph.materialized()), str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").glob("comp=*")) == ["comp=1", "comp=5"]


def test_parts_as_often_as_met(spark, tmp_path):
    """Pairs that need not be distinct are not moved again."""
    from vertexloom.sources import tables

    spark.createDataFrame([(o, n, n % 2) for o in range(6) for n in range(4)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    graph = tables.part_succession(spark, str(tmp_path), once=False)
    assert not graph.once and sorted(tuple(x) for x in graph.edges.collect()) == [(0, 1)] * 12 + [(1, 0)] * 6
    plan = graph.edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_parts_on_following_lines(spark, tmp_path):
    """Repeated and missing numbers, nulls, and numbers with many lines, over batches of a few rows."""
    from vertexloom.sources import tables

    r = random.Random(5)
    lines = [(o, r.choice([1, 2, 3, 4, 6, None]), r.choice([*range(40), None])) for o in [*range(30), None] for _ in range(r.randint(0, 12))] + [(99, k // 40, k) for k in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(p, q) for o, n, p in lines for o2, m, q in lines if o is not None and o == o2 and n is not None and m == n + 1}
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            graph = tables.part_succession(spark, str(tmp_path))
            got = [tuple(x) for x in graph.edges.collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(want) and set(got) == want
    assert graph.once and "Exchange" in (plan := graph.edges._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan  # two moves of the lines before
