"""Every query against DuckDB on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from granary.plans import catalogue

AT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, AT)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    result = duck.sql(catalogue.oracle_sql()[name])
    names = list(result.columns)
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
