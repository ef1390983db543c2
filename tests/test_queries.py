import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(value(r[c]) for c in columns) for r in df.collect()]
    sql = entry.catalog.ORACLE_SQL.get(name)
    if sql:
        r = duck.sql(sql)
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        key = lambda x: [(v is None, str(v)) for v in x]
        assert sorted(rows, key=key) == sorted([tuple(value(x[i]) for i in at) for x in r.fetchall()], key=key)


def test_entry(spark):
    assert entry.entry(spark).count() == 4
