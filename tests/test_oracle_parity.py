"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, rows_of

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLE[name]).df()
    gcols, grows = rows_of(got)
    wcols, wrows = rows_of(want)
    assert gcols == wcols
    assert len(got) == len(want)
    assert grows == wrows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"timestamp", "city", "metric", "alert_type", "severity", "message"}
    assert df.count() >= 0
