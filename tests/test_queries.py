"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from gleaner.plans import registry

TABLES = "/root/testdata/sf0.001"


def compare(spark, query, sql, folder):
    import duckdb

    found = query(spark, folder)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"create view {file.split('.')[0]} as select * from '{folder}/{file}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    rows = cursor.fetchall()
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in rows)
    got = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name in registry.ORACLE:
        compare(spark, registry.QUERIES[name], registry.ORACLE[name], TABLES)
    else:
        assert registry.QUERIES[name](spark, TABLES).count() > 0


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
