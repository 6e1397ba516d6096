"""What tasks of season refits and of Elo are given, and calibrations by values of one feature."""

import numpy as np
import pytest

from paceline.operators import boosting, elo, ratings, walkforward


def games(spark, n=900):
    rng = np.random.default_rng(7)
    x = np.round(rng.standard_normal(n), 1)
    rows = [(i, 2000 + i // 300, int(rng.random() < 1 / (1 + np.exp(-2 * x[i]))), 0, None if i % 50 == 0 else float(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "game_id long, season int, home_win int, margin int, x double")


def test_refits_shuffle_no_row(spark):
    df = games(spark)
    made = boosting.refits(df, [boosting.Setting(f"m{k}", ("x",), lambda: boosting.Boosted(5), 150) for k in range(3)])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") >= 6  # a row stood there once a setting and season before
    assert made.count() == 3 * (600 - 12)


def test_codes_are_bytes_by_feature():
    x = np.random.default_rng(0).standard_normal((500, 4))
    x[::7, 2] = np.nan
    codes = boosting.binned(x, [np.linspace(-2, 2, boosting.BINS - 1)] * 4)
    assert codes.dtype == np.uint8 and codes.flags.f_contiguous and (codes[::7, 2] == boosting.BINS).all()
    tree = boosting.grown(codes, x[:, 0], np.ones(500), 3, 1.0, 20)
    assert (tree.leaves(codes) == tree.leaves(codes.astype(np.int64))).all()


def test_calibrations_are_fits_of_rows(spark):
    df = games(spark)
    got = boosting.calibrations(df, {"a": ("x", 150), "late": ("x", 400)}).toPandas().set_index(["model", "game_id"])["p"]
    fixed = lambda: boosting.Logistic(1e6, scale=False)
    want = boosting.refits(df, [boosting.Setting("a", ("x",), fixed, 150), boosting.Setting("late", ("x",), fixed, 400)]).toPandas().set_index(["model", "game_id"])["p"]
    assert len(got) == len(want) and got.sort_index().to_numpy() == pytest.approx(want.sort_index().to_numpy(), abs=1e-6)
    x, y = np.repeat([-1.0, 0.0, 2.0], 40), np.random.default_rng(1).random(120) < np.repeat([0.2, 0.5, 0.8], 40)
    by_row = boosting.Logistic(1e6, scale=False).fit(x[:, None], y.astype(float)).b
    by_value = boosting.Logistic(1e6, scale=False).fit(np.array([[-1.0], [0.0], [2.0]]), y.reshape(3, 40).mean(1), np.full(3, 40.0)).b
    assert by_value == pytest.approx(by_row, abs=1e-5)


def test_elo_sets_of_regression_side_by_side(spark):
    rng = np.random.default_rng(5)
    sides = [rng.choice(12, 2, replace=False) for _ in range(400)]
    rows = [(i, 2000 + i // 100, 0, i % 100 // 10, None, f"t{h}", f"t{a}", int(m > 0), int(m), bool(i % 9 == 0)) for i, ((h, a), m) in enumerate(zip(sides, rng.choice([-20, -7, -1, 3, 8, 30], 400)))]
    df = spark.createDataFrame(rows, "game_id long, season int, st_order int, week int, start_date date, home_team string, away_team string, home_win int, margin int, neutral_site boolean")
    shares = [(k, s, f"t{t}", 0.02 + 0.05 * t * (k + 1) % 0.6) for k in range(3) for s in (2001, 2003) for t in range(0, 12, 2)]
    every = spark.createDataFrame(shares, "param_id int, season int, team string, regress double")
    got = elo.pregame_by_team(df, every, sets=3, size=90).toPandas().set_index(["param_id", "game_id"]).sort_index()
    assert len(got) == 1200
    for k in range(3):
        one = elo.pregame_by_team(df, every.where(f"param_id = {k}").drop("param_id")).toPandas().set_index("game_id").sort_index()
        assert got.loc[k].to_numpy() == pytest.approx(one.to_numpy(), abs=1e-9)


def test_elo_state_is_a_row_a_team(spark):
    df = spark.createDataFrame([(i, 2000, 0, i // 4, None, f"t{i % 5}", f"t{(i + 1) % 5}", 1, 3, False) for i in range(40)], "game_id long, season int, st_order int, week int, start_date date, home_team string, away_team string, home_win int, margin int, neutral_site boolean")
    made, ends, _ = elo._played(df, elo.grid(spark).where("param_id < 8"), size=10, sides=False)
    assert (made.count(), ends.count()) == (40, 5)  # 320 and 40 before
    a, b = (f(df, elo.grid(spark), size=10).select("param_id", "game_id", "p").orderBy("param_id", "game_id").collect() for f in (elo.chances, elo.pregame))
    assert a == b and len(a) == 45 * 40


def test_sums_by_home_team_alone(spark):
    cols = "season int, period int, start_date date, home_team string, away_team string, neutral_site boolean, home_win int, margin int, home_points int, away_points int"
    rows = [(2000 + i // 30, i // 10, None, f"t{i % 2}", f"t{2 + i % 7}", False, i % 2, i % 5 - 2, 10, 8) for i in range(60)]
    g = spark.createDataFrame(rows, cols)
    sums = walkforward.pair_sums(g, by=["home_team"])
    assert sums.count() == 12 and walkforward.pair_sums(g).count() > 12  # massey_recent_weights was given the pairs before
    cal = ratings.calendar(g)
    made = [walkforward.running(walkforward.steps(s, cal, ["home_team"], {"n": ("n", 0.5), "m": ("m", 1.0)}), cal, ["home_team"], ["n", "m"]).orderBy("period", "home_team").collect() for s in (sums, walkforward.pair_sums(g))]
    assert made[0] == made[1] and len(made[0]) == 10
