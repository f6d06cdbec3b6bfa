"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from palimpsest.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(str(r[i]) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)
