"""The corpus queries that SQL can express, against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from paceline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
