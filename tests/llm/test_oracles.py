"""Queries with SQL, held against DuckDB on the smallest tables."""

import duckdb
import pytest

from gatecast.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(map(str, (tuple(r[c] for c in rel.columns) for r in df.collect()))) == sorted(map(str, rel.fetchall()))
