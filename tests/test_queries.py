"""Registered queries against their SQL, as far as both run quickly here; sources and functions."""

import duckdb
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paceline.functions import scalar
from paceline.plans import registry
from paceline.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    return f"{float(v):.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "fiu" else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].map(text).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(scalar.decimal_odds(F.lit(-110.0))) == pytest.approx(1 + 100 / 110)
    assert value(scalar.decay(0.0, F.lit(0))) == 1
    assert value(scalar.right_closed(F.lit(0.0), (0.0, 3.0, 7.0))) is None
    assert value(scalar.left_closed(F.lit(0.0), (0.0, 3.0, 7.0))) == "[0,3)"
    assert value(scalar.first_price(F.lit("['1','0']"))) == 1
    assert value(scalar.first_price(F.lit("oops"))) is None
    assert value(scalar.calibration_bin(F.lit(1.0))) == 9
    assert value(scalar.utc_offset(F.lit("Nowhere"))) is None and value(scalar.utc_offset(F.lit("America/Phoenix"))) == -7
    assert value(scalar.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(20015.09, abs=0.1)
    days = scalar.whole_days(F.to_timestamp(F.lit("2000-01-02 01:00:00")), F.to_timestamp(F.lit("2000-01-01 23:00:00")))
    assert value(days) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "plays_2014.csv").write_text("a,b\n1,x\n2,oops\n")
    rows = tables.read_csv(spark, [str(tmp_path / "plays_2014.csv")], "a int, b string").collect()
    assert [(r["a"], r["file_year"]) for r in rows] == [(1, 2014), (2, 2014)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(df, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "t"), build).count() == 2
    assert len(calls) == 1
    tables.write_csv(df, str(tmp_path / "c"))
    tables.write_partitioned(df, str(tmp_path / "p"), "k")
    assert tables.read_existing(spark, str(tmp_path / "p")).count() == 2
