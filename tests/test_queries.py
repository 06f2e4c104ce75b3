"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from tracewright.plans import more_queries, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
assert more_queries


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(str(r[i]) for i in order) for r in found)


# The round trips of whole documents plan for long; test_sources.py has them on small ones.
@pytest.mark.parametrize("name", sorted(n for n in queries.SQL if not n.endswith("_roundtrip")))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    sql = duck.sql(queries.SQL[name])
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())
