import duckdb
import pytest

from millrace.llm import queries
from tests.test_queries import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = duck.execute(queries.ORACLE_SQL[name])
    theirs = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(theirs)
    want = sorted(tuple(plain(r[theirs.index(c)]) for c in sorted(theirs)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(theirs)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
