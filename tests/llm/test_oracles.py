"""Every query with SQL against DuckDB on the smallest tables, whole rows compared; and SQL's own XXH64 against the library's."""

import random

import duckdb
import pytest
import xxhash

from granary.llm import queries, simhash_sql

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    frame = queries.queries()[name](spark, AT)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    result = con.sql(queries.oracle_sql()[name])
    names = list(result.columns)
    assert sorted(names) == columns
    assert got == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in result.fetchall()) and got


def test_hashes_in_sql():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcé ñ漢xyz") for _ in range(n)) for n in [*range(1, 80), 100, 200, 1000]]
    con = duckdb.connect()
    con.execute("CREATE TABLE s (shingle VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?)", [(x,) for x in texts])
    steps = ", ".join(f"{name} AS ({select})" for name, select in simhash_sql.xxh64_steps(42))
    assert dict(con.sql(f"WITH {steps} SELECT * FROM hashed").fetchall()) == {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in texts}
