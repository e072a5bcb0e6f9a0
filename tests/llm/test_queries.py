"""The registered queries of the operators against their SQL in DuckDB, where SQL can express them."""

import duckdb
import pytest

from tessera.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    expected = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == expected
