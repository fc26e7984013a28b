"""Every registered query of the graph library against its SQL, or for rows."""

import os

import duckdb
import pytest

from weftgraph.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.select(*sorted(df.columns)).collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    out = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(df.columns)
    at = [out.columns.index(c) for c in sorted(out.columns)]
    assert sorted(repr(tuple(r[i] for i in at)) for r in out.fetchall()) == sorted(repr(tuple(r)) for r in rows)


def test_entry_module_imports(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() == 50
