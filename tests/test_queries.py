"""Every registered query outside the llm subpackage against its SQL, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from loomwork.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return x or 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return [plain(y) for y in x] if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(x) for x in r]) for r in df.select(columns).collect())
    if name in SQL:
        found = duck.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
        assert sorted(duck.sql(SQL[name]).columns) == columns
        assert rows == sorted(repr([plain(x) for x in r]) for r in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
