"""Every registered query with SQL, held against DuckDB on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from tallystream.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    run = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in run.description]
    want = run.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = ([tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows] for rows, cols in ((got, df.columns), (want, names)))
    assert sorted(a) == sorted(b)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "t" and df.count() > 0


def test_scans_read_only_what_a_query_needs(spark):
    from tallystream.sources import streams

    plan = streams.request_spells(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters: [IsNotNull(o_orderdate), LessThan(o_orderdate" in plan
