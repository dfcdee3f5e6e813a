"""Every query against DuckDB, value by value, on the smallest tables."""

import math

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return repr(float(v)) if hasattr(v, "normalize") else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    result = duck.execute(catalog.ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(theirs)
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in sorted(theirs)) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(theirs)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
