"""Tables in versions, files of unknown columns, and the bootstrap by vectors."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import models, quantiles
from paceline.sources import tables
from paceline.sources.versioned import Table


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_see_whole_versions(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"))
    assert t.read() is None
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert t.upsert(first, ["k"]) == 1
    begun = t.read()
    seen = []
    real = t._point
    monkeypatch.setattr(t, "_point", lambda n, folder: seen.append(rows(t.read())) or real(n, folder))
    assert t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]) == 2
    assert seen == [[(1, "a"), (2, "b")]]  # written, not yet published
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d")] and rows(begun) == [(1, "a"), (2, "b")]

    def fails(n, folder):
        raise OSError("lost")

    monkeypatch.setattr(t, "_point", fails)
    with pytest.raises(OSError):
        t.upsert(spark.createDataFrame([(9, "x")], "k int, v string"), ["k"])
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d")]
    monkeypatch.setattr(t, "_point", real)
    with pytest.raises(RuntimeError):
        t.publish(first, after=1)  # another writer was first
    assert t.upsert(spark.createDataFrame([(4, "e")], "k int, v string"), ["k"]) == 3
    assert t.expire(keep=1, hours=0) == 4 and list(t.versions()) == [3]
    assert rows(t.read()) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")] and rows(Table(spark, str(tmp_path / "t")).read()) == rows(t.read())


def test_columns_are_discovered(spark, tmp_path):
    (tmp_path / "a_2001.csv").write_text('k,v,"x, y"\n1,one,0.5\n2,,2\n')
    (tmp_path / "b_2002.csv").write_text("﻿v,k\ntwo,3\nthree,\n")
    (tmp_path / "c_2003.csv").write_text("k,v,x\n n4 ,7,8\n")
    (tmp_path / "d_2004.csv").write_text("")
    with gzip.open(tmp_path / "e_2005.csv.gz", "wt") as f:
        f.write("k,w,w,\n5,1,2,z\n")
    (tmp_path / "f_2006.csv").write_text("k,w,w,\n6,10,1e3,\n")
    got = tables.discovered(spark, str(tmp_path))
    assert dict(got.dtypes) == {"k": "string", "v": "string", "x, y": "double", "x": "bigint", "w": "bigint", "w_2": "double", "_c3": "string", "file_year": "int"}
    assert sorted(map(str, (tuple(r[c] for c in ("file_year", "k", "v", "x, y", "x", "w", "w_2", "_c3")) for r in got.collect()))) == sorted(map(str, [
        (2001, "1", "one", 0.5, None, None, None, None), (2001, "2", None, 2.0, None, None, None, None), (2002, "3", "two", None, None, None, None, None), (2002, None, "three", None, None, None, None, None),
        (2003, " n4 ", "7", None, 8, None, None, None), (2005, "5", None, None, None, 1, 2.0, "z"), (2006, "6", None, None, None, 10, 1000.0, None),
    ]))
    assert tables.discovered(spark, str(tmp_path / "d_2004.csv")).collect() == []


def test_bootstrap_by_vectors(spark):
    rng = np.random.default_rng(0)
    d = rng.standard_normal(3000) * 2 + 0.3
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)] + [(9999, None)], "game_id long, diff double")
    a, b = (models.bootstrap(df.repartition(n)).first() for n in (1, 7))
    assert (a["n"], a["mean"]) == (3000, pytest.approx(d.mean())) and (a["lo"], a["hi"]) == pytest.approx((b["lo"], b["hi"]))
    half = 1.96 * d.std() / np.sqrt(3000)
    assert (a["lo"], a["hi"]) == pytest.approx((d.mean() - half, d.mean() + half), abs=0.15 * half)
    w = models.poisson_weights(np.arange(2000), 500)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    keys = np.arange(3000)
    means = d @ models.poisson_weights(keys, 2000) / models.poisson_weights(keys, 2000).sum(0)
    assert (a["lo"], a["hi"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    none = models.bootstrap(df.where(F.lit(False))).first()
    assert (none["n"], none["mean"], none["lo"]) == (0, None, None)


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(1)
    for values in (rng.standard_normal(3000) ** 3, np.r_[np.zeros(2000), rng.random(500), np.full(700, 1e300), -1e300], np.full(50, 2.5), np.array([1.0]), np.r_[np.arange(1000) * 1e-12, 1e12]):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,), (float("nan"),)], "x double").repartition(5)
        shares = (0.0, 0.1, 0.5, 0.75, 0.999, 1.0)
        assert quantiles.quantiles(df, "x", shares, few=20) == pytest.approx(list(np.quantile(values, shares)))
    assert quantiles.quantiles(df.where("x > 1e13"), "x", (0.5,)) == [None]
