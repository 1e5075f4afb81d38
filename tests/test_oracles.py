"""Every query of the catalog against DuckDB on the same tables; all have SQL."""

import os

import duckdb
import pytest

from vertexloom.plans import catalog

# Of those whose oracles tell nothing new on the smallest tables, and of one loop many times, one of each is enough here.
ONCE = ("gen_lineof", "gen_latticeof", "gen_latticeloopedof", "gen_latticeonerow", "hop_dist_compat", "bfs_layers_compat", "scc_users", "scc_nested", "terminal_parts", "terminal_members")
SHOWN = [n for n in catalog.ORACLE_SQL if not n.startswith(ONCE)]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", SHOWN)
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
    assert got == want
    assert got


def test_catalog_is_registered():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)
