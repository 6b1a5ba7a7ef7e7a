"""Every query of the catalogue with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from recordlake import plans

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equal_to_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    result = duck.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_entry_names_a_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "n"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
