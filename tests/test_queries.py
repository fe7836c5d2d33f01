"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pairfield import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object)
    return columns, sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


def against_duckdb(spark, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(query(spark, DATA).toPandas()) == rows(con.execute(sql).df())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, name):
    against_duckdb(spark, catalog.QUERIES[name], catalog.ORACLE[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())
