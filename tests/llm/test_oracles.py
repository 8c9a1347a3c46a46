"""The queries that SQL can express against their SQL in DuckDB."""

import duckdb
import pytest

from sparkseek.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert sorted(map(tuple, got[want.columns].astype(object).values.tolist())) == sorted(map(tuple, want.astype(object).values.tolist()))
