"""Corpus queries with SQL agree with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quern.llm import queries as Q


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_matches_sql(spark, sf, name):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df, cur = Q.queries()[name](spark, sf), c.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str([r[k] for k in columns]) for r in df.collect()) == sorted(str(list(r)) for r in cur.fetchall())
