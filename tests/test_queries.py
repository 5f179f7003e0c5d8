"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    mine = got.select(*cols).toPandas().astype(str)
    other = con.sql(ORACLE_SQL[name]).df()
    assert sorted(other.columns) == cols
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(mine) == rows(other)
    assert len(mine)


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    if not os.path.isdir(SF):
        pytest.skip("needs the driver's tables")
    plan = QUERIES["distinct_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,450000.0)" in QUERIES["semi_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
