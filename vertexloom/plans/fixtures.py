"""SQL of the graphs that queries run on, and helpers to write their oracles."""

from __future__ import annotations

# Edges by graph: parts that follow one another, users that follow one another (a multigraph), users to the ones behind their first and last event, a bipartite graph.
PARTS = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"
FOLLOW = "SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, row_number() OVER (ORDER BY ts, event_id) AS k FROM events"
USERS = f"SELECT src, dst FROM ({FOLLOW}) WHERE dst IS NOT NULL"
OUTER = f"SELECT src, arg_min(dst, k) AS dst FROM ({FOLLOW}) WHERE dst IS NOT NULL GROUP BY src UNION SELECT src, arg_max(dst, k) FROM ({FOLLOW}) WHERE dst IS NOT NULL GROUP BY src"
TRADE = "SELECT DISTINCT o.o_custkey AS src, l.l_suppkey + 1000000000 AS dst FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"


def ctes(edges: str) -> str:
    """WITH e (src, dst) and v (id)."""
    return f"WITH RECURSIVE e AS MATERIALIZED ({edges}), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def hops(edges: str, root: str, depth: int = 40) -> str:
    """CTEs down to h (id, dist): least hops from a root."""
    return f"{ctes(edges)}, r AS (SELECT CAST({root} AS BIGINT) AS id, 0 AS dist UNION SELECT e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.id WHERE r.dist < {depth}), h AS (SELECT id, min(dist) AS dist FROM r GROUP BY id)"


def closure(edges: str) -> str:
    """CTEs down to c (id, comp): the least id of those mutually reachable.

    What a vertex with many edges reaches and is reached by (g) is one component. It becomes one node (the
    least id of it), and t is the closure over the nodes, which are few where g is large.
    """
    return (
        f"{ctes(edges)}, p AS MATERIALIZED (SELECT src AS id FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), "
        "f AS (SELECT id FROM p UNION SELECT e.dst FROM f JOIN e ON e.src = f.id), b AS (SELECT id FROM p UNION SELECT e.src FROM b JOIN e ON e.dst = b.id), "
        "g AS MATERIALIZED (SELECT f.id FROM f JOIN b ON b.id = f.id), k AS MATERIALIZED (SELECT v.id, CASE WHEN g.id IS NULL THEN v.id ELSE (SELECT min(id) FROM g) END AS node FROM v LEFT JOIN g ON g.id = v.id), "
        "r AS MATERIALIZED (SELECT DISTINCT a.node AS src, b.node AS dst FROM e JOIN k a ON a.id = e.src JOIN k b ON b.id = e.dst WHERE a.node <> b.node), "
        "t AS (SELECT DISTINCT node AS s, node AS t FROM k UNION SELECT t.s, r.dst FROM t JOIN r ON r.src = t.t), "
        "m AS MATERIALIZED (SELECT a.s AS node, min(a.t) AS comp FROM t a JOIN t b ON a.s = b.t AND a.t = b.s GROUP BY a.s), c AS MATERIALIZED (SELECT k.id, m.comp FROM k JOIN m ON m.node = k.node)"
    )


def quotient(edges: str) -> str:
    """CTEs down to q (src_comp, dst_comp)."""
    return f"{closure(edges)}, q AS MATERIALIZED (SELECT DISTINCT a.comp AS src_comp, b.comp AS dst_comp FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst WHERE a.comp <> b.comp)"


def pagerank(edges: str, steps: int) -> str:
    """CTEs down to p<steps> (id, rank)."""
    out = f"{ctes(edges)}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), p0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"
    for k in range(1, steps + 1):
        out += f", p{k} AS MATERIALIZED (SELECT v.id, 0.15 + 0.85 * coalesce(s.got, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(p.rank / o.n) AS got FROM e JOIN p{k - 1} p ON p.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) s ON s.dst = v.id)"
    return out


def pagerank_converged(edges: str, steps: int) -> str:
    """CTEs down to p<steps> (id, rank, delta): a round is only taken while the last summed change was over 0.001."""
    out = f"{ctes(edges)}, o AS (SELECT src, count(*) AS n FROM e GROUP BY src), z AS (SELECT count(*)::DOUBLE AS n FROM v), p0 AS (SELECT id, 1 / z.n AS rank, CAST('inf' AS DOUBLE) AS delta FROM v, z)"
    for k in range(1, steps + 1):
        out += (
            f", n{k} AS MATERIALIZED (SELECT p.id, p.rank AS old, p.delta, 0.15 / z.n + 0.85 * coalesce(s.got, 0) AS rank FROM p{k - 1} p CROSS JOIN z LEFT JOIN (SELECT e.dst, sum(p.rank / o.n) AS got FROM e JOIN p{k - 1} p ON p.id = e.src JOIN o ON o.src = e.src GROUP BY e.dst) s ON s.dst = p.id)"
            f", p{k} AS MATERIALIZED (SELECT id, CASE WHEN delta > 0.001 THEN rank ELSE old END AS rank, CASE WHEN delta > 0.001 THEN (SELECT sum(abs(rank - old)) FROM n{k}) ELSE delta END AS delta FROM n{k})"
        )
    return out


# Shapes of generated graphs as SQL: (number of vertices, edges).
def line(n: int) -> tuple[int, str]:
    return n, f"SELECT i AS src, i + 1 AS dst FROM range({n - 1}) t(i)"


def reverse(sql: str) -> str:
    return f"SELECT dst AS src, src AS dst FROM ({sql})"


def biline(n: int) -> tuple[int, str]:
    return n, f"{line(n)[1]} UNION ALL {reverse(line(n)[1])}"


def ring(n: int) -> tuple[int, str]:
    return n, f"SELECT i AS src, (i + 1) % {n} AS dst FROM range({n}) t(i)"


def biring(n: int) -> tuple[int, str]:
    return n, f"{ring(n)[1]} UNION ALL SELECT i, (i + {n - 1}) % {n} FROM range({n}) t(i)"


def clique(n: int) -> tuple[int, str]:
    return n, f"SELECT a.i AS src, b.i AS dst FROM range({n}) a(i), range({n}) b(i) WHERE a.i <> b.i"


def tree(height: int, branch: int) -> tuple[int, str]:
    size = lambda h: (branch ** (h + 1) - 1) // (branch - 1)
    sizes = ", ".join(str(size(h)) for h in range(height)) or "0"
    walk = f"WITH RECURSIVE w(src, id, d) AS (SELECT -1::BIGINT, 0::BIGINT, 0 UNION ALL SELECT w.id, w.id + 1 + k * ([{sizes}])[{height} - d], d + 1 FROM w, range({branch}) t(k) WHERE d < {height})"
    return size(height), f"SELECT src, id AS dst FROM ({walk} SELECT * FROM w) WHERE d > 0"


def lattice(rows: int, cols: int, loop_rows: bool, loop_cols: bool, rows_filled: int | None = None, cols_filled: int | None = None) -> tuple[int, str]:
    rf, cf = rows if rows_filled is None else rows_filled, cols if cols_filled is None else cols_filled
    cells = f"range({rows}) a(r), range({cols}) b(c)"
    east = f"SELECT r * {cols} + c AS src, r * {cols} + (c + 1) % {cols} AS dst FROM {cells} WHERE r < {rf} AND ({loop_rows} OR c < {cols - 1})"
    south = f"SELECT r * {cols} + c AS src, ((r + 1) % {rows}) * {cols} + c AS dst FROM {cells} WHERE c < {cf} AND ({loop_cols} OR r < {rows - 1})"
    return rows * cols, f"{east} UNION ALL {south}"


def product(macro: tuple[int, str], micro: tuple[int, str], cellwise: bool) -> tuple[int, str]:
    (a, big), (b, small) = macro, micro
    cells = f", range({b}) k(cell)" if cellwise else ""
    cell = " + cell" if cellwise else ""
    inner = f"SELECT t.i * {b} + m.src AS src, t.i * {b} + m.dst AS dst FROM range({a}) t(i), ({small}) m"
    return a * b, f"{inner} UNION ALL SELECT src * {b}{cell}, dst * {b}{cell} FROM ({big}) g{cells}"
