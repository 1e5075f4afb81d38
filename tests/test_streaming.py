import datetime as dt

from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators import iterate
from vertexloom.streaming import edges as E

SCHEMA = "src long, dst long, ts timestamp"


def feed(spark, tmp_path, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_windowed_degrees_with_late_edges(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    m = lambda k: t + dt.timedelta(minutes=k)
    feed(spark, tmp_path, [(1, 2, m(1)), (1, 3, m(2)), (2, 3, m(30))], 0)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = E.windowed_degrees(stream, late="10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c"))

    def run():
        out.trigger(availableNow=True).start().awaitTermination()

    run()
    feed(spark, tmp_path, [(1, 4, m(59)), (9, 9, m(200))], 1)
    run()
    feed(spark, tmp_path, [(1, 5, m(5)), (9, 9, m(400))], 2)  # the first is behind the watermark
    run()
    got = {(r.window_start, r.id): r.degree for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[(t, 1)] == 3 and got[(t, 2)] == 1


def test_distances_follow_new_edges(spark, tmp_path):
    """Each batch by a new keeper, as after a restart; a batch that comes twice; null ends."""
    path = str(tmp_path / "state")
    batches = [[(0, 1), (1, 2), (2, 3), (None, 4), (3, None)], [(7, 8), (3, 4)], [(0, 3), (4, 7)], [(8, 9)]]
    seen = []
    for k, b in enumerate(batches):
        for _ in range(2 if k == 1 else 1):
            E.DistanceKeeper(0, path)(spark.createDataFrame(b, "src long, dst long"), k)
        seen += b
        graph = Graph.of_edges(spark.createDataFrame(seen, "src long, dst long"))
        want = {r.id: r.dist for r in E.distances(graph, 0).collect()}
        assert {r.id: r.dist for r in E.DistanceKeeper(0, path).distances(spark).collect()} == want
    assert want == {0: 0, 1: 1, 2: 2, 3: 1, 4: 2, 7: 3, 8: 4, 9: 5}
    assert E.DistanceKeeper(0, path).generations(spark) == [2, 3]  # older ones are deleted
    written = spark.read.parquet(f"{path}/edges").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in written} == {0: 3, 1: 2, 2: 2, 3: 1}  # a batch writes its own edges alone
    assert {r.id: r.dist for r in E.DistanceKeeper(5, str(tmp_path / "none")).distances(spark).collect()} == {5: 0}


def test_small_frontiers_go_several_edges_a_round(spark, tmp_path):
    """A path that later edges shorten, with repeated ones; a round for each edge before."""
    path = str(tmp_path / "state")
    keep = lambda rows, n: E.DistanceKeeper(0, path)(spark.createDataFrame(rows, "src long, dst long"), n)
    iterate.LOG.clear()
    keep([(i, i + 1) for i in range(12) for _ in range(3)], 0)
    assert len([x for x in iterate.LOG if x[0] == "improve"]) <= 7
    keep([(0, 5), (0, 5), (2, 9), (12, 0)], 1)
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 2, 7: 3, 8: 4, 9: 3, 10: 4, 11: 5, 12: 6}
    assert {r.id: r.dist for r in E.DistanceKeeper(0, path).distances(spark).collect()} == want


def test_distinct_edges(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    feed(spark, tmp_path, [(1, 2, t), (1, 2, t), (2, 1, t)], 0)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    E.distinct_edges(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("pairs").agg(F.count(F.lit(1))).first()[0] == 2
