"""Every query of the library's own operators against its SQL, on the smallest tables."""

import pytest
from conftest import TINY, duck, rows_of

from tracewell import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, TINY).toPandas()) == duck(catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, TINY).count() > 0


@pytest.mark.parametrize("name", ["o08_key_sort_whole", "o09_compound_whole"])
def test_whole_sorts_hold_every_position(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("part", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TINY}/{table}.parquet'")
    want = [r[0] for r in con.execute(catalog.ORACLE_SQL[name]).fetchall()]
    assert len(want) > 100 and [r[0] for r in catalog.QUERIES[name](spark, TINY).collect()] == want


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
