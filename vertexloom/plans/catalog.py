"""All queries by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.index import beside
from ..graph import Graph
from ..operators import collectives, degrees, iterate, layout, pregel, rank, reach, search, traversal, triangles
from ..operators import components as C
from ..sources import generators, petri, segments, sinks, spec, tables
from ..storage import fresh, stored
from ..streaming import edges as stream_edges
from . import fixtures as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


parts, users, outer, trade = tables.part_succession, tables.user_succession, tables.outer_succession, tables.customer_suppliers


def kept(make: Callable[[SparkSession, str], Graph]) -> Callable[[SparkSession, str], Graph]:
    """The graph, written once: for queries that read it more than once."""
    return lambda spark, d: make(spark, d).materialized()


parts_kept, users_kept, outer_kept, trade_kept = kept(parts), kept(users), kept(outer), kept(trade)
parts_met = kept(lambda spark, d: parts(spark, d, once=False))


# Scans, degrees, views


@query(f"{S.ctes(S.PARTS)} SELECT degree, count(*) AS cnt FROM (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) GROUP BY degree")
def degree_hist(spark, d):
    return degrees.degree_histogram(parts(spark, d))


@query(f"{S.ctes(S.USERS)} SELECT degree, count(*) AS cnt FROM (SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id) GROUP BY degree")
def in_degree_hist(spark, d):
    return degrees.degree_histogram(users(spark, d), incoming=True)


@query(
    f"{S.ctes(S.PARTS)} SELECT count(*) AS n, count(DISTINCT degree) AS distinct_values, min(degree) AS min_value, max(degree) AS max_value, round(avg(degree), 6) AS mean_value, round(stddev_samp(degree), 6) AS stdev FROM (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"
)
def degree_stats(spark, d):
    return degrees.histogram_statistics(degrees.degree_histogram(parts(spark, d)))


@query(
    f"{S.ctes(S.PARTS)}, g AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id), a AS (SELECT avg(degree) AS m, count(*) AS n FROM g) SELECT (SELECT n FROM a) AS n, count(*) AS distinct_values, min(degree) AS min_value, max(degree) AS max_value, round((SELECT m FROM a), 6) AS mean_value, round(sqrt(sum((degree - (SELECT m FROM a)) ** 2)) / ((SELECT n FROM a) - 1), 6) AS stdev FROM (SELECT DISTINCT degree FROM g)"
)
def degree_stats_compat(spark, d):
    return degrees.histogram_statistics(degrees.degree_histogram(parts(spark, d)), compat=True)


@query(f"{S.ctes(S.USERS)} SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id")
def out_degrees(spark, d):
    return users(spark, d).out_degrees()


@query(f"{S.ctes(S.USERS)} SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def in_degrees(spark, d):
    return users(spark, d).in_degrees()


@query(f"SELECT dst AS src, src AS dst FROM ({S.USERS})")
def transpose(spark, d):
    return users(spark, d).transpose().edges


@query(f"SELECT src, dst FROM ({S.USERS}) UNION ALL SELECT dst, src FROM ({S.USERS})")
def undirected(spark, d):
    return users(spark, d).undirected().edges


@query(f"SELECT dst AS id FROM ({S.PARTS}) WHERE src = 1")
def neighbors(spark, d):
    return parts(spark, d).neighbors(1)


@query(f"SELECT src AS id FROM ({S.PARTS}) WHERE dst = 1")
def in_neighbors(spark, d):
    return parts(spark, d).in_neighbors(1)


@query(f"{S.ctes(S.PARTS)} SELECT id FROM v WHERE id = 7")
def point_lookup(spark, d):
    return parts(spark, d).vertex(7)


@query(f"SELECT src AS id, array_to_string(list_sort(list(dst)), ' ') AS neighbors FROM ({S.USERS}) GROUP BY src")
def adjacency(spark, d):
    return users(spark, d).adjacency().select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), " ").alias("neighbors"))


def dumped(most: str) -> str:
    text = lambda end: f"coalesce((SELECT string_agg({end}::VARCHAR, ' ' ORDER BY {end}) FROM e WHERE e.{'src' if end == 'dst' else 'dst'} = x.id), '')"
    return f"{S.ctes(S.USERS)} SELECT x.id, {text('dst')} AS targets, {text('src')} AS sources FROM (SELECT id FROM v ORDER BY id {most}) x"


def as_text(df: DataFrame) -> DataFrame:
    words = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return df.select("id", words("targets"), words("sources"))


@query(dumped(""))
def graph_dump(spark, d):
    return as_text(users_kept(spark, d).dump())


@query(dumped("LIMIT 10"))
def graph_dump_head(spark, d):
    return as_text(users_kept(spark, d).dump(10))


@query(
    f"{S.ctes(S.USERS)} SELECT (SELECT count(*) FROM v) AS vertices, count(*) AS edges, round(count(*) / (SELECT count(*) FROM v), 6) AS avg_degree, count(*) FILTER (src = dst) AS loops, count(*) - (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM e)) AS parallel FROM e"
)
def graph_info(spark, d):
    return users_kept(spark, d).info()


@query(
    "SELECT c.c_nationkey::BIGINT AS src, s.s_nationkey::BIGINT AS dst, count(*) AS w FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY ALL"
)
def weighted_edges(spark, d):
    return tables.nation_trade(spark, d)


@query("SELECT count(*) AS links, count(DISTINCT dst) AS targets FROM (SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages)")
def page_links(spark, d):
    return tables.page_links(spark, d).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("dst").alias("targets"))


@query("WITH l AS (SELECT url AS src, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dst FROM pages), n AS (SELECT src AS name FROM l UNION SELECT dst FROM l) SELECT name, row_number() OVER (ORDER BY encode(name)) - 1 AS id FROM n WHERE name IS NOT NULL")
def page_numbers(spark, d):
    return tables.numbered(tables.page_links(spark, d))[1]


# Traversals


@query(f"{S.hops(S.PARTS, '1')} SELECT v.id, h.dist FROM v LEFT JOIN h ON h.id = v.id")
def hop_dist(spark, d):
    return traversal.hop_distance(parts_kept(spark, d), 1)


@query(f"{S.hops(S.PARTS, '1')} SELECT v.id, coalesce(h.dist, 2147483647) AS dist FROM v LEFT JOIN h ON h.id = v.id")
def hop_dist_compat(spark, d):
    return traversal.hop_distance(parts_kept(spark, d), 1, compat=True)


@query(f"{S.hops(S.TRADE, '(SELECT min(id) FROM v)')} SELECT v.id, h.dist FROM v LEFT JOIN h ON h.id = v.id")
def hop_dist_bipartite(spark, d):
    return traversal.hop_distance(trade_kept(spark, d))


@query(f"{S.hops(S.PARTS, '1')} SELECT dist, count(*) AS cnt FROM h GROUP BY dist")
def bfs_layers(spark, d):
    return traversal.bfs_layers(parts_kept(spark, d), 1)


@query(f"{S.hops(S.PARTS, '1')} SELECT greatest(dist - 1, 0) AS dist, count(*) AS cnt FROM h GROUP BY ALL")
def bfs_layers_compat(spark, d):
    return traversal.bfs_layers(parts_kept(spark, d), 1, compat=True)


@query(f"{S.hops(S.PARTS, '1')} SELECT count(*) AS visited, max(dist) + 1 AS layers, round(avg(dist), 6) AS avg_dist FROM h")
def bfs_summary(spark, d):
    return traversal.bfs_summary(parts_kept(spark, d), 1)


@query(f"{S.hops(S.USERS, '(SELECT min(id) FROM v)')} SELECT (SELECT count(*) FROM h) AS visited, (SELECT count(*) FROM e JOIN h ON h.id = e.src) + 1 AS visit_calls")
def visit_count(spark, d):
    return traversal.visit_count(users_kept(spark, d))


VISITS = "SELECT (SELECT count(*) FROM v) AS visited, count(*) + 1 AS rounds FROM (SELECT DISTINCT node FROM k) n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.t = n.node AND t.s < n.node)"


@query(f"{S.closure(S.USERS)} {VISITS}")
def visit_all(spark, d):
    return traversal.visit_all(users_kept(spark, d))


@query(f"{S.closure(S.OUTER)} {VISITS}")
def visit_all_sparse(spark, d):
    return traversal.visit_all(outer_kept(spark, d))


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM ({S.USERS}) UNION SELECT dst, src FROM ({S.USERS})), r AS (SELECT min(src) AS id FROM e UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT count(*) AS echoes FROM r")
def echo(spark, d):
    return traversal.echo(users_kept(spark, d))


TREE = f"{S.hops(S.PARTS, '1')}, w AS MATERIALIZED (SELECT h.id, h.dist, min(a.id) AS father FROM h LEFT JOIN (SELECT e.dst, a.id, a.dist FROM e JOIN h a ON a.id = e.src) a ON a.dst = h.id AND a.dist = h.dist - 1 GROUP BY h.id, h.dist)"


@query(f"{TREE} SELECT id, dist, father FROM w")
def search_tree(spark, d):
    return traversal.search_tree(parts_kept(spark, d), 1)


@query(f"{TREE} SELECT w.id, g.n AS degree FROM w LEFT JOIN (SELECT v.id, count(e.src) AS n FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id) g ON g.id = w.father")
def father_degree(spark, d):
    """A join on a stored reference: what each vertex's father has."""
    graph = parts_kept(spark, d)
    return traversal.to_father(traversal.search_tree(graph, 1), graph.out_degrees(), "degree")


@query(f"{TREE}, up AS (SELECT id, id AS top, father FROM w UNION ALL SELECT up.id, w.id, w.father FROM up JOIN w ON w.id = up.father) SELECT top AS id, count(*) AS size FROM up GROUP BY top")
def echo_sizes(spark, d):
    tree = stored(traversal.search_tree(parts_kept(spark, d), 1), "tree")
    return traversal.echo_sizes(tree)


@query("SELECT true AS within, true AS seeds_kept, true AS repeats")
def cascade(spark, d):
    """What holds of any cascade: it stays within what the seeds reach, takes no seed twice, and the same draw gives the same result."""
    graph = users_kept(spark, d)
    seeds = stored(traversal.cascade_seeds(graph, 10), "seeds")
    a, b = stored(traversal.cascade(graph, seeds), "cascade"), traversal.cascade(graph.transpose().transpose(), seeds)
    far = reach.reached(graph.edges, seeds)
    outside = a.join(far, "id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("within"))
    taken = seeds.join(a, "id", "left_semi").agg((F.count(F.lit(1)) <= 10).alias("seeds_kept"))
    same = a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti")).agg((F.count(F.lit(1)) == 0).alias("repeats"))
    return beside(beside(outside, taken), same)


@query(f"{S.ctes(S.OUTER)}, r AS (SELECT id FROM (SELECT id FROM v ORDER BY id LIMIT 3) UNION SELECT e.dst FROM r JOIN e ON e.src = r.id) SELECT id FROM r")
def cascade_certain(spark, d):
    """A cascade whose draws all succeed, from the three least vertices."""
    graph = outer_kept(spark, d)
    return traversal.cascade(graph, graph.vertices.orderBy("id").limit(3), p=1.0)


@query(f"SELECT src AS id, max(dst) AS top FROM ({S.PARTS}) GROUP BY src HAVING max(dst) > src")
def message_filter(spark, d):
    """One message round backward with a guard: vertices with a larger neighbour."""
    graph = parts(spark, d)
    state = graph.vertices.select("id", F.lit(0).cast("long").alias("top"))
    new = pregel.message_round(state, graph.transpose().edges, F.col("id"), F.max("msg"), {"top": F.coalesce("merged", F.lit(0))})
    return new.filter("top > id")


@query(f"{S.ctes(S.PARTS)} SELECT id FROM v EXCEPT SELECT dst FROM e UNION ALL (SELECT src FROM e INTERSECT SELECT dst FROM e)")
def label_sets(spark, d):
    """Set algebra over vertex sets: those without edges in, and those with edges in and out."""
    g = parts(spark, d)
    sources, targets = g.edges.select(F.col("src").alias("id")).distinct(), g.edges.select(F.col("dst").alias("id")).distinct()
    return g.vertices.subtract(targets).union(sources.intersect(targets))


# Reductions


DEGREES = f"{S.ctes(S.PARTS)}, g AS (SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"


@query(f"{DEGREES} SELECT min(degree) AS least, max(degree) AS largest, sum(degree)::BIGINT AS total, round(avg(degree), 6) AS mean FROM g")
def reduce_extent(spark, d):
    return collectives.extent(parts(spark, d).out_degrees(), "degree")


@query(f"{DEGREES} SELECT coalesce(bool_or(degree > 20), false) AS anywhere, coalesce(bool_and(degree > 20), true) AS everywhere FROM g")
def reduce_flags(spark, d):
    return collectives.flags(parts(spark, d).out_degrees(), F.col("degree") > 20)


@query(f"{DEGREES} SELECT sum(degree)::BIGINT AS degree, sum(degree % 2)::BIGINT AS odd FROM g")
def reduce_counters(spark, d):
    return collectives.vector_sum(parts(spark, d).out_degrees().withColumn("odd", F.col("degree") % 2), "degree", "odd")


@query(f"{DEGREES} SELECT min(id) FILTER (degree > 15) AS pivot FROM g")
def reduce_pivot(spark, d):
    return collectives.pivot(parts(spark, d).out_degrees(), F.col("degree") > 15)


@query(f"SELECT src AS id FROM ({S.USERS}) UNION SELECT dst FROM ({S.PARTS})")
def reduce_union(spark, d):
    return collectives.union_of(users(spark, d).edges.select(F.col("src").alias("id")), parts(spark, d).edges.select(F.col("dst").alias("id")))


@query(f"{DEGREES}, x AS (SELECT id, degree FROM g ORDER BY degree DESC, id LIMIT 3) SELECT (SELECT count(*) FROM g) AS n, (SELECT array_to_string(list(id ORDER BY degree DESC, id), ' ') FROM x) AS top")
def reduce_custom(spark, d):
    """A reduction over a payload of its own: a count and the three vertices of most edges."""
    best = lambda xs: sorted(set(xs), key=lambda x: (-x[0], x[1]))[:3]
    count, top = collectives.reduce_custom(
        parts(spark, d).out_degrees(),
        (0, []),
        lambda got, row: (got[0] + 1, best([*got[1], (row["degree"], row["id"])])),
        lambda a, b: (a[0] + b[0], best(a[1] + b[1])),
    )
    return spark.createDataFrame([(count, " ".join(str(i) for _, i in top))], "n long, top string")


@query(f"{S.ctes(S.PARTS)} SELECT count(*) AS vertices, true AS spread FROM v")
def partition_balance(spark, d):
    found = collectives.partition_balance(parts(spark, d).vertices)
    return found.select(F.round(F.col("partitions") * F.col("mean_rows")).cast("long").alias("vertices"), (F.col("stdev_rows") >= 0).alias("spread"))


@query(f"{S.ctes(S.PARTS)} SELECT count(*) AS vertices FROM v")
def partition_sizes(spark, d):
    return parts(spark, d).partition_sizes().agg(F.sum("vertices").alias("vertices"))


@query("SELECT 'reach' AS loop, 12::BIGINT AS rows, true AS timed")
def run_statistics(spark, d):
    """What the loops of a driver did: here, the reach of a line of twelve."""
    iterate.LOG.clear()
    traversal.reach(generators.line(spark, 12).edges, spark.range(1))
    return iterate.statistics(spark).select("loop", "rows", (F.col("seconds") >= 0).alias("timed"))


# Ranks, triangles, layout


@query(f"{S.pagerank(S.USERS, 5)} SELECT id, round(rank, 6) AS rank FROM p5")
def pagerank_fixed(spark, d):
    return rank.pagerank(users_kept(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


@query(f"{S.pagerank(S.PARTS, 5)} SELECT id, round(rank, 6) AS rank FROM p5")
def pagerank_parts(spark, d):
    return rank.pagerank(parts_kept(spark, d), 5).select("id", F.round("rank", 6).alias("rank"))


@query(f"{S.pagerank_converged(S.PARTS, 20)} SELECT id, round(rank, 6) AS rank FROM p20")
def pagerank_converged(spark, d):
    return rank.pagerank_converged(parts_kept(spark, d))[0].select("id", F.round("rank", 6).alias("rank"))


@query(f"{S.pagerank(S.PARTS, 5)} SELECT round(min(rank), 6) AS min_rank, round(max(rank), 6) AS max_rank, round(sum(rank), 4) AS sum_rank FROM p5")
def pagerank_summary(spark, d):
    return rank.rank_summary(rank.pagerank(parts_kept(spark, d), 5))


CYCLES = f"{S.ctes(S.PARTS)}, c AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst), n AS (SELECT id, count(*) AS n FROM (SELECT unnest([x, y, z]) AS id FROM c) GROUP BY id)"


@query(f"{CYCLES} SELECT id, n FROM n")
def triangles_cycle(spark, d):
    return triangles.triangle_counts(parts_kept(spark, d))


@query(f"{CYCLES} SELECT v.id, coalesce(n.n, 0) AS n FROM v LEFT JOIN n ON n.id = v.id ORDER BY 2 DESC, 1 LIMIT 10")
def triangles_top(spark, d):
    return triangles.top_triangles(parts_kept(spark, d))


@query(f"{S.ctes(S.PARTS)}, g AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT a.dst AS id, sum(g.n)::BIGINT AS n FROM e a JOIN e b ON b.src = a.dst AND b.dst = a.src JOIN g ON g.dst = a.src GROUP BY a.dst")
def triangles_compat(spark, d):
    return triangles.triangle_counts(parts_kept(spark, d), compat=True)


def moved(k: int) -> str:
    return f", l{k} AS MATERIALIZED (SELECT v.id, (l.x + coalesce(m.x, l.x)) / 2 AS x, (l.y + coalesce(m.y, l.y)) / 2 AS y FROM v JOIN l{k - 1} l ON l.id = v.id LEFT JOIN (SELECT b.dst, avg(l.x) AS x, avg(l.y) AS y FROM b JOIN l{k - 1} l ON l.id = b.src GROUP BY b.dst) m ON m.dst = v.id)"


@query(f"{S.ctes(S.USERS)}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT id, (id * 37 % 600)::DOUBLE AS x, (id * 101 % 600)::DOUBLE AS y FROM v){moved(1)}{moved(2)} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM l2")
def layout_rounds(spark, d):
    found = layout.layout(users_kept(spark, d), F.col("id") * 37 % 600, F.col("id") * 101 % 600)
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Components


CYCLE = f"{S.closure(S.PARTS)} SELECT id, comp FROM c"


@query(CYCLE)
def scc(spark, d):
    return C.strong_components(parts_met(spark, d))


@query(f"{S.closure(S.USERS)} SELECT id, comp FROM c")
def scc_users(spark, d):
    """In rounds down to the last edge."""
    return C.strong_components(users_kept(spark, d), finish=0)


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_sparse(spark, d):
    return C.strong_components(outer_kept(spark, d), finish=0)


@query(f"{S.ctes(S.TRADE)} SELECT id, id AS comp FROM v")
def scc_bipartite(spark, d):
    return C.strong_components(trade_kept(spark, d))


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_forward_backward(spark, d):
    return C.strong_components_fb(outer_kept(spark, d), finish=64)


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_candidates(spark, d):
    return C.strong_components_fb(outer_kept(spark, d), finish=64, candidates=True)


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_slices(spark, d):
    return C.strong_components_obf(outer_kept(spark, d), finish=64)


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_random_slices(spark, d):
    return C.strong_components_obf(outer_kept(spark, d), finish=64, random_pivots=True)


@query(f"{S.closure(S.OUTER)} SELECT id, comp FROM c")
def scc_nested_slices(spark, d):
    return C.strong_components_obf(outer_kept(spark, d), finish=64, random_pivots=True, seed=2, nesting=1)


@query(f"{S.closure(S.OUTER)} SELECT size, count(*) AS n FROM (SELECT comp, count(*) AS size FROM c GROUP BY comp) GROUP BY size")
def scc_sizes(spark, d):
    return C.size_histogram(C.strong_components(outer_kept(spark, d)))


@query(f"{S.quotient(S.OUTER)} SELECT src_comp, dst_comp FROM q")
def scc_quotient(spark, d):
    graph = outer_kept(spark, d)
    return C.quotient(graph, C.strong_components(graph))


@query(f"{S.quotient(S.OUTER)} SELECT DISTINCT comp FROM c WHERE comp NOT IN (SELECT src_comp FROM q)")
def terminal_scc(spark, d):
    graph = outer_kept(spark, d)
    comps = C.strong_components(graph)
    return C.terminal_components(comps, C.quotient(graph, comps))


TERMINAL = "SELECT id, comp FROM c WHERE comp NOT IN (SELECT src_comp FROM q)"


@query(f"{S.quotient(S.OUTER)} {TERMINAL}")
def terminal_by_colour(spark, d):
    return C.terminal_by_colour(outer_kept(spark, d))


@query(f"{S.quotient(S.PARTS)} {TERMINAL}")
def terminal_parts(spark, d):
    return C.terminal_by_colour(parts_met(spark, d))


@query(f"{S.quotient(S.OUTER)} {TERMINAL}")
def terminal_by_reach(spark, d):
    return C.terminal_by_reach(outer_kept(spark, d))


@query(f"{S.quotient(S.OUTER)} {TERMINAL}")
def terminal_by_reach_untrimmed(spark, d):
    return C.terminal_by_reach(outer_kept(spark, d), trimmed=False)


# a source's depth is one more than that of the nearest leaf: the least depth among its targets, all of which have one
DEPTHS = f"{S.quotient(S.OUTER)}, w AS (SELECT DISTINCT comp, 0 AS depth FROM c WHERE comp NOT IN (SELECT src_comp FROM q) UNION SELECT q.src_comp, w.depth + 1 FROM w JOIN q ON q.dst_comp = w.comp WHERE w.depth < 60), u AS MATERIALIZED (SELECT comp, min(depth) AS depth FROM w GROUP BY comp)"


@query(f"{DEPTHS} SELECT comp, depth FROM u")
def quotient_depth(spark, d):
    graph = outer_kept(spark, d)
    comps = C.strong_components(graph)
    return C.quotient_depths(comps, C.quotient(graph, comps))


@query(f"{DEPTHS} SELECT comp, depth FROM u")
def quotient_depth_rounds(spark, d):
    graph = outer_kept(spark, d)
    comps = C.strong_components(graph)
    return C.quotient_depths(comps, C.quotient(graph, comps), finish=0)


@query(f"{S.ctes(S.TRADE)} SELECT v.id AS comp, CASE WHEN v.id IN (SELECT src FROM e) THEN 1 ELSE 0 END AS depth FROM v")
def quotient_depth_bipartite(spark, d):
    graph = trade_kept(spark, d)
    return C.quotient_depths(graph.vertices.select(F.col("id").alias("comp")), graph.edges.toDF("src_comp", "dst_comp"))


@query(f"{S.quotient(S.OUTER)} SELECT comp, id, id::VARCHAR AS name FROM c WHERE comp NOT IN (SELECT src_comp FROM q)")
def terminal_members(spark, d):
    return C.terminal_members(outer_kept(spark, d))


# Generators


def generated(name: str, form: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spec.load_graph(spark, form, text).edges

    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({sql})"


for _name, _form, _text, _sql in (
    ("gen_line", "Line", "1000", S.line(1000)),
    ("gen_biline", "BiLine", "50", S.biline(50)),
    ("gen_ring", "Ring", "1000", S.ring(1000)),
    ("gen_biring", "BiRing", "7", S.biring(7)),
    ("gen_clique", "Clique", "20", S.clique(20)),
    ("gen_bintree", "BinTree", "9", S.tree(9, 2)),
    ("gen_tree", "Tree", "4:3", S.tree(4, 3)),
    ("gen_lattice", "Lattice", "6:5", S.lattice(6, 5, False, False)),
    ("gen_lattice_looped_rows", "LatticeLoopedRows", "6:5", S.lattice(6, 5, True, False)),
    ("gen_lattice_looped_cols", "LatticeLoopedCols", "6:5", S.lattice(6, 5, False, True)),
    ("gen_lattice_looped", "LatticeLooped", "6:5", S.lattice(6, 5, True, True)),
    ("gen_lmlmtn", "LmLmTn", "3:3", S.product(S.tree(3, 2), S.lattice(3, 3, True, True), True)),
    ("gen_limlon", "LimLon", "3:4", S.product(S.lattice(3, 3, False, False), S.lattice(4, 4, True, True), True)),
):
    generated(_name, _form, _text, _sql[1])

_leaves = {"Lattices": ("3", S.lattice(3, 3, True, True)), "Lines": ("4", S.line(4)), "BiLines": ("4", S.biline(4)), "Cliques": ("4", S.clique(4)), "Rings": ("5", S.ring(5)), "BiRings": ("5", S.biring(5)), "Trees": ("2:3", S.tree(2, 3))}
_shapes = {
    "TreeOf": ("2", S.tree(2, 2)),
    "LineOf": ("4", S.line(4)),
    "LatticeOf": ("3:2", S.lattice(3, 2, False, False)),
    "LatticeLoopedOf": ("3:2", S.lattice(3, 2, True, True)),
    "LatticeOneRowConnectedOf": ("3:2", S.lattice(3, 2, False, True, 1, 2)),
    "LatticeOneRowLoopedOf": ("3:2", S.lattice(3, 2, True, False, 1, 2)),
}
for _shape, (_outer, _macro) in _shapes.items():
    for _leaf, (_inner, _micro) in _leaves.items():
        generated(f"gen_{_shape}{_leaf}".lower(), _shape + _leaf, f"{_outer}:{_inner}", S.product(_macro, _micro, False)[1])


def traits(graph: Graph, n: int, mean: float | None = None, off: float = 0.0) -> DataFrame:
    """One row of what holds of a random graph whatever the draws: vertices, ids in range, repeated pairs, mean out-degree as it should be."""
    sums = graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("edges"), F.sum(F.col("n") - 1).alias("repeated"), (F.min(F.least("src", "dst")) >= 0).alias("above"), (F.max(F.greatest("src", "dst")) < n).alias("below")
    )
    got = beside(graph.vertices.agg(F.count(F.lit(1)).alias("vertices")), sums)
    near = F.lit(True) if mean is None else F.abs(F.col("edges") / n - mean) <= off
    return got.select("vertices", "edges", "repeated", (F.col("above") & F.col("below")).alias("in_range"), near.alias("as_meant"))


@query("SELECT 1000::BIGINT AS vertices, 4000::BIGINT AS edges, 1000::BIGINT AS on_ring, 4::BIGINT AS degree, true AS in_range")
def gen_ring_with_shortcuts(spark, d):
    """All ring edges, and three more for each vertex."""
    graph = spec.load_graph(spark, "RingWithShortcuts", "1000:3:7")
    ring = graph.edges.filter((F.col("src") + 1) % 1000 == F.col("dst")).agg(F.countDistinct("src").alias("on_ring"))
    degree = graph.out_degrees().agg(F.min("degree").alias("least"), F.max("degree").alias("most")).select(F.when(F.col("least") == F.col("most"), F.col("least")).alias("degree"))
    return beside(beside(traits(graph, 1000), ring), degree).select("vertices", "edges", "on_ring", "degree", "in_range")


MEANT = "true AS in_range, true AS as_meant"


@query(f"SELECT 300::BIGINT AS vertices, 0::BIGINT AS repeated, {MEANT}")
def gen_slow_erdos(spark, d):
    return traits(spec.load_graph(spark, "SlowErdos", "300:5:7"), 300, 5, 0.8).drop("edges")


@query(f"SELECT 1000::BIGINT AS vertices, 0::BIGINT AS repeated, {MEANT}")
def gen_fast_erdos(spark, d):
    return traits(spec.load_graph(spark, "FastErdos", "1000:8:7"), 1000, 8, 0.55).drop("edges")


def law_of_degrees(name: str, form: str, text: str, n: int, mean: float, off: float) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return traits(spec.load_graph(spark, form, text), n, mean, off).drop("edges", "repeated")

    QUERIES[name], ORACLE_SQL[name] = run, f"SELECT {n}::BIGINT AS vertices, {MEANT}"


# means of the laws, and five deviations of the mean of n draws
for _name, _form, _text, _n, _mean, _off in (
    ("gen_approximate_erdos", "ApproximateErdos", "1000:8:7", 1000, 8, 0.45),
    ("gen_log_normal", "LogN", "1000:1.5:0.8:7", 1000, 6.17, 0.95),
    ("gen_pareto", "Pareto", "1000:2:2.5:7", 1000, 3.33, 0.6),
    ("gen_uniform", "Uniform", "1000:2:9:7", 1000, 5.5, 0.35),
    ("gen_discrete_uniform", "DiscreteUniform", "1000:2:9:7", 1000, 5.5, 0.37),
    ("gen_normal", "Normal", "1000:10:2:7", 1000, 10, 0.33),
):
    law_of_degrees(_name, _form, _text, _n, _mean, _off)


@query("SELECT 500::BIGINT AS vertices, 499::BIGINT AS edges, true AS one_father, 2::BIGINT AS most_kids, 500::BIGINT AS reached")
def gen_randomized_tree(spark, d):
    graph = spec.load_graph(spark, "RandomizedTree", "500:7")
    fathers = graph.in_degrees().filter("id <> 0").agg((F.min("degree") + F.max("degree") == 2).alias("one_father"))
    kids = graph.out_degrees().agg(F.max("degree").alias("most_kids"))
    reached = traversal.reach_set(graph.edges, spark.range(1)).agg(F.count(F.lit(1)).alias("reached"))
    return beside(beside(beside(traits(graph, 500), fathers), kids), reached).select("vertices", "edges", "one_father", "most_kids", "reached")


@query(f"SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM ({S.product(S.tree(2, 2), S.lattice(2, 2, True, True), False)[1]})")
def make_rooted_tree(spark, d):
    """Generated, written as Parquet and read back."""
    path = fresh(spark, "made")
    spec.make_graph(spark, "LmLmBTn", "2:2", path, out="parquet")
    return Graph.load(spark, path).edges


NET = ("a & ^b -> c", "c -> b & a", "b -| a")
# Markings of three places of 0..2 as base-3 numbers, in the order a, b, c; the moves of NET's rules
MARKS = "s AS (SELECT i AS id, i % 3 AS a, i // 3 % 3 AS b, i // 9 % 3 AS c FROM range(27) r(i))"
MOVES = "SELECT id AS src, id - 1 + 9 AS dst FROM s WHERE a > 0 AND b = 0 AND c < 2 UNION SELECT id, id - 9 + 3 + 1 FROM s WHERE c > 0 AND b < 2 AND a < 2 UNION SELECT id, id - 3 - 1 FROM s WHERE b > 0 AND a > 0"
# the same where ordinary inputs gain, and an inhibiting one loses, as far as there is room
GAINS = "SELECT id AS src, id + least(a + 1, 2) - a + 9 AS dst FROM s WHERE a > 0 AND b = 0 AND c < 2 UNION SELECT id, id + 9 * (least(c + 1, 2) - c) + 3 + 1 FROM s WHERE c > 0 AND b < 2 AND a < 2 UNION SELECT id, id + 3 * (least(b + 1, 2) - b) - 1 FROM s WHERE b > 0 AND a > 0"
# of the biological net: inputs stay, outputs stop at the bounds, and a marked place that no rule would fill loses one
GROWTH = "SELECT id AS src, id + 9 * (least(c + 1, 2) - c) AS dst FROM s WHERE a > 0 AND b = 0 UNION SELECT id, id + 3 * (least(b + 1, 2) - b) + least(a + 1, 2) - a FROM s WHERE c > 0 UNION SELECT id, id - a + greatest(a - 1, 0) FROM s WHERE b > 0 UNION SELECT id, id - 1 FROM s WHERE a > 0 AND c = 0 UNION SELECT id, id - 3 FROM s WHERE b > 0 AND c = 0 UNION SELECT id, id - 9 FROM s WHERE c > 0 AND NOT (a > 0 AND b = 0)"


def written_net(spark: SparkSession) -> str:
    path = fresh(spark, "net")
    spark.createDataFrame([(x,) for x in NET], "value string").coalesce(1).write.text(path)
    return path


@query(f"WITH {MARKS} SELECT src, dst FROM ({MOVES})")
def petri_states(spark, d):
    return spec.load_graph(spark, "PetriNetStateSpace", f"2:{written_net(spark)}").edges


@query(f"WITH {MARKS} SELECT src, dst FROM ({GAINS})")
def petri_states_compat(spark, d):
    return spec.load_graph(spark, "PetriNetStateSpace", f"2:{written_net(spark)}", compat=True).edges


BIO = f"SELECT src, dst FROM (WITH {MARKS} SELECT src, dst FROM ({GROWTH})) WHERE src <> dst"


@query(BIO)
def petri_biological(spark, d):
    return petri.PetriNet.parse(NET, 2, biological=True).graph(spark).edges


@query(
    f"WITH RECURSIVE e AS MATERIALIZED ({BIO}), v AS (SELECT i AS id FROM range(27) r(i)), t AS (SELECT id AS s, id AS t FROM v UNION SELECT t.s, e.dst FROM t JOIN e ON e.src = t.t), c AS MATERIALIZED (SELECT a.s AS id, min(a.t) AS comp FROM t a JOIN t b ON a.s = b.t AND a.t = b.s GROUP BY a.s), "
    "o AS (SELECT DISTINCT x.comp FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.comp <> y.comp), m AS (SELECT id, comp, id % 3 AS a, id // 3 % 3 AS b, id // 9 % 3 AS c FROM c WHERE comp NOT IN (SELECT comp FROM o)) "
    "SELECT comp, id, trim(CASE WHEN a > 0 THEN 'a=' || a ELSE '' END || CASE WHEN b > 0 THEN ' b=' || b ELSE '' END || CASE WHEN c > 0 THEN ' c=' || c ELSE '' END) AS marking FROM m"
)
def petri_terminal_members(spark, d):
    """Terminal components of a biological net, with markings."""
    net = petri.PetriNet.parse(NET, 2, biological=True)
    return net.markings(C.terminal_members(net.graph(spark).materialized()).select("comp", "id"))


# Formats


def round_trip(spark: SparkSession, d: str, form: str, compact: bool = False) -> DataFrame:
    """The users' multigraph written and read back, under its old ids."""
    graph = users_kept(spark, d)
    path = fresh(spark, form)
    places = segments.write_graph(graph, path, form, segments=3, compact=compact)
    got = segments.read_graph(spark, path, form)
    bases = segments.read_header(path, form).bases()
    names = places.select("id", (F.element_at(F.array(*[F.lit(b).cast("long") for b in bases]), F.col("segment") + 1) + F.col("offset")).alias("new"))
    a, b = names.select(F.col("new").alias("src"), F.col("id").alias("s")), names.select(F.col("new").alias("dst"), F.col("id").alias("d"))
    return got.edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


@query(S.USERS)
def hip_round_trip(spark, d):
    return round_trip(spark, d, "hip")


@query(S.USERS)
def hip_compact_round_trip(spark, d):
    return round_trip(spark, d, "hip", compact=True)


@query(S.USERS)
def svcii_round_trip(spark, d):
    return round_trip(spark, d, "svcii")


@query(S.USERS)
def parquet_round_trip(spark, d):
    path = fresh(spark, "graph")
    users_kept(spark, d).save(path)
    return Graph.load(spark, path).edges


@query(f"SELECT '  ' || src || ' -> ' || dst || ';' AS line FROM ({S.USERS})")
def dot_export(spark, d):
    return sinks.dot_lines(users(spark, d))


def written(spark: SparkSession, d: str, form: str, segments_: int = 3) -> str:
    path = fresh(spark, form)
    segments.write_graph(users_kept(spark, d), path, form, segments=segments_)
    return path


PLACED = f"{S.ctes(S.USERS)}, n AS MATERIALIZED (SELECT id, (row_number() OVER (ORDER BY id) - 1) % 3 AS segment FROM v)"


@query(f"{PLACED} SELECT segment::INTEGER AS segment, count(*) AS states, (SELECT count(*) FROM e JOIN n a ON a.id = e.src WHERE a.segment = n.segment) AS edges_out, (SELECT count(*) FROM e JOIN n b ON b.id = e.dst WHERE b.segment = n.segment) AS edges_in FROM n GROUP BY segment")
def header_dump(spark, d):
    return segments.read_header(written(spark, d, "hip"), "hip").describe(spark)


@query(f"{PLACED} SELECT 'src-' || a.segment || '-' || b.segment AS file, count(*) AS numbers FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY ALL")
def raw_numbers(spark, d):
    found = segments.raw_numbers(spark, written(spark, d, "svcii"), "src-*")
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("numbers"))


QUOTIENT_DOT = (
    f"{DEPTHS}, z AS (SELECT comp, count(*) AS size FROM c GROUP BY comp), x AS MATERIALIZED (SELECT z.comp, z.size, u.depth FROM z JOIN u ON u.comp = z.comp WHERE u.depth <= 3 ORDER BY u.depth, z.comp LIMIT 1000), y AS (SELECT comp, size, round(255 * size / (SELECT max(size) FROM x))::INTEGER AS level FROM x) "
    "SELECT '  ' || comp || ' [label=\"' || size || '\", fillcolor=\"#' || lpad(lower(to_hex(level)), 2, '0') || '40' || lpad(lower(to_hex(255 - level)), 2, '0') || '\"];' AS line FROM y UNION ALL SELECT '  ' || src_comp || ' -> ' || dst_comp || ';' FROM q WHERE src_comp IN (SELECT comp FROM x) AND dst_comp IN (SELECT comp FROM x)"
)


@query(QUOTIENT_DOT)
def quotient_dot(spark, d):
    graph = outer_kept(spark, d)
    comps = C.strong_components(graph)
    edges = stored(C.quotient(graph, comps), "quotient")
    return sinks.quotient_dot_lines(C.component_sizes(comps), edges, C.quotient_depths(comps, edges), deepest=3)


@query(
    f"{DEGREES} SELECT '# min ' || min(degree) AS line FROM g UNION ALL SELECT '# max ' || max(degree) FROM g UNION ALL SELECT '# avg ' || round(avg(degree), 6) FROM g UNION ALL SELECT '# stdev ' || round(stddev_samp(degree), 6) FROM g "
    "UNION ALL SELECT '# unique ' || count(DISTINCT degree) FROM g UNION ALL SELECT '# all ' || count(*) FROM g UNION ALL SELECT count(*) || ' ' || degree FROM g GROUP BY degree"
)
def histogram_file(spark, d):
    return sinks.histogram_lines(degrees.degree_histogram(parts(spark, d)))


@query(f"{S.quotient(S.OUTER)} SELECT comp, count(*) AS members FROM c WHERE comp NOT IN (SELECT src_comp FROM q) GROUP BY comp")
def member_listing(spark, d):
    """Members of terminal components as text files, a folder for each component, read back."""
    path = fresh(spark, "members")
    sinks.write_members(C.terminal_members(outer_kept(spark, d)), path)
    return spark.read.text(path).groupBy(F.col("comp").cast("long").alias("comp")).agg(F.count(F.lit(1)).alias("members"))


@query(f"{S.ctes(S.PARTS)} SELECT id, (id % 5)::VARCHAR || '@' || (id % 3)::VARCHAR AS name, (id % 3) * 4294967296 + id % 5 AS packed, id % 4 + 10 * (id // 4 % 4) AS digits FROM v")
def scalar_functions(spark, d):
    ids = parts(spark, d).vertices
    digits = scalar.decode_radix(F.col("id"), 4, 2)
    return ids.select(
        "id",
        scalar.reference_name(F.col("id") % 3, F.col("id") % 5).alias("name"),
        scalar.pack_reference(F.col("id") % 3, F.col("id") % 5).alias("packed"),
        scalar.encode_radix(digits, 10).alias("digits"),
    )


# Implicit state spaces


def counters(state: bytes) -> list[bytes]:
    """Two counters up to 6: the first goes up, the second follows it; both at the top go back to nothing."""
    a, b = state
    out = [bytes((a + 1, b))] if a < 6 else []
    if b < a:
        out.append(bytes((a, b + 1)))
    if (a, b) == (6, 6):
        out.append(bytes((0, 0)))
    return out


@query("SELECT 28::BIGINT AS stored, 43::BIGINT - 28 + 1 AS matched, 43::BIGINT AS transitions, 12 AS max_depth, 2 AS max_state_bytes")
def search_statistics(spark, d):
    return search.explore(spark, [bytes((0, 0))], counters).statistics()


@query("SELECT a * 10 + b AS state FROM range(7) x(a), range(7) y(b) WHERE b <= a AND a = 6")
def search_accepting_cycles(spark, d):
    found = search.explore(spark, [bytes((0, 0))], counters).accepting_cycle_states(lambda s: s[0] == 6)
    return found.select((F.conv(F.hex(F.substring("state", 1, 1)), 16, 10).cast("long") * 10 + F.conv(F.hex(F.substring("state", 2, 1)), 16, 10).cast("long")).alias("state"))


@query("SELECT 2 AS a, 2 AS b UNION ALL SELECT 3, 0")
def search_deadlocks(spark, d):
    def steps(state: bytes) -> list[bytes]:
        a, b = state
        return [x for x in (bytes((a + 1, b)) if a < 2 or (a < 3 and b == 0) else None, bytes((a, b + 1)) if b < 2 and a < 3 else None) if x]

    found = search.explore(spark, [bytes((0, 0))], steps).deadlocks()
    byte = lambda i: F.conv(F.hex(F.substring("state", i, 1)), 16, 10).cast("int")
    return found.select(byte(1).alias("a"), byte(2).alias("b"))


SEATS = 7


def philosophers(state: bytes) -> list[bytes]:
    """Philosophers at a round table take the left fork, then the right one, then lay both down: 0 thinks, 1 has the left fork, 2 eats. All with one fork is a deadlock."""
    out = []
    for i, x in enumerate(state):
        before, behind = state[i - 1], state[(i + 1) % len(state)]
        if (x == 0 and before != 2) or (x == 1 and behind == 0):
            out.append(state[:i] + bytes((x + 1,)) + state[i + 1 :])
        elif x == 2:
            out.append(state[:i] + b"\0" + state[i + 1 :])
    return out


_power = [3**k for k in range(SEATS)]
_digit = lambda place: f"r.s // ({_power})[{place} + 1] % 3"
TABLE = (
    f"WITH RECURSIVE x(i) AS (SELECT unnest(range({SEATS}))), a AS MATERIALIZED (SELECT r.s, i, {_digit("i")} AS own, {_digit(f"(i + {SEATS - 1}) % {SEATS}")} AS before, {_digit(f"(i + 1) % {SEATS}")} AS behind FROM range({3**SEATS}) r(s), x), "
    f"e AS MATERIALIZED (SELECT s AS src, (CASE WHEN own = 2 THEN s - 2 * ({_power})[i + 1] ELSE s + ({_power})[i + 1] END)::BIGINT AS dst FROM a WHERE (own = 0 AND before <> 2) OR (own = 1 AND behind = 0) OR own = 2), "
    "h AS (SELECT 0::BIGINT AS id UNION SELECT e.dst FROM h JOIN e ON e.src = h.id)"
)


@query(f"{TABLE} SELECT (SELECT count(*) FROM h) AS stored, count(*) AS transitions, (SELECT count(*) FROM h WHERE id NOT IN (SELECT src FROM e)) AS deadlocks, {SEATS} AS max_state_bytes FROM e JOIN h ON h.id = e.src")
def model_check(spark, d):
    """The table of philosophers searched whole; that all hold one fork is its only error."""
    found = search.check(spark, [bytes(SEATS)], philosophers, max_errors=0)
    return beside(found.report, found.errors.agg(F.count(F.lit(1)).alias("deadlocks"))).select("stored", "transitions", "deadlocks", "max_state_bytes")


@query(f"{TABLE} SELECT count(*) AS states FROM h WHERE (id % 3) = 2")
def model_check_cycles(spark, d):
    """States on a cycle in which the first philosopher eats."""
    found = search.check(spark, [bytes(SEATS)], philosophers, deadlocks=False, accepting=lambda s: s[0] == 2, max_errors=0)
    return found.errors.filter("kind = 'acceptance cycle'").agg(F.count(F.lit(1)).alias("states"))


# Streams


def stream_of(spark: SparkSession, rows: DataFrame, files: int) -> DataFrame:
    """rows as a stream of small batches, dealt out by a hash: dealing them in turn sorts them first."""
    path = fresh(spark, "stream")
    rows.repartition(files, *rows.columns).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, user_id AS id, count(*) AS degree FROM events GROUP BY ALL")
def stream_windowed_degrees(spark, d):
    """Degrees by hour of a stream of all events, each batch replacing the result."""
    events = tables.table(spark, d, "events").select(F.col("user_id").alias("src"), F.col("ts").cast("timestamp").alias("ts"))
    path = fresh(spark, "windows")
    found = stream_edges.windowed_degrees(stream_of(spark, events, 4))
    sink = found.writeStream.outputMode("complete").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path))
    sink.option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("window_start timestamp, id long, degree long").parquet(path).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "id", "degree")


@query(f"{S.hops(S.PARTS, '1')} SELECT id, dist FROM h")
def stream_distances(spark, d):
    """Distances kept up to date over a stream of all edges; a second process takes the place of the first half-way."""
    edges, path = parts(spark, d, once=False).edges, fresh(spark, "distances")
    sink = stream_of(spark, edges, 4).writeStream.foreachBatch(lambda batch, n: stream_edges.DistanceKeeper(1, path)(batch, n))
    sink.option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return stream_edges.DistanceKeeper(1, path).distances(spark)


@query(f"SELECT DISTINCT src, dst FROM ({S.USERS})")
def stream_distinct_edges(spark, d):
    path = fresh(spark, "pairs")
    edges = users(spark, d).edges.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    sink = stream_edges.distinct_edges(stream_of(spark, edges, 4)).select("src", "dst").writeStream.format("parquet").option("path", path)
    sink.option("checkpointLocation", fresh(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("src long, dst long").parquet(path)
