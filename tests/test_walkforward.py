"""Walk-forward systems on pair sums against games themselves, season refits, and what sources and sinks do with odd input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceline.functions import scalar
from paceline.operators import boosting, boxscore, elo, ratings, snapshot, walkforward
from paceline.sources import tables

GAMES = "game_id long, season int, st_order int, week int, period int, start_date date, home_team string, away_team string, home_points int, away_points int, neutral_site boolean, home_win int, margin int, home_division string, away_division string"


def league(n=240, teams=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        season, week = 2000 + i // 80, i % 80 // 8 + 1
        h, a = rng.choice(teams, 2, replace=False)
        hp, ap = int(rng.integers(0, 45)), int(rng.integers(0, 45))
        ap += hp == ap
        day = pd.Timestamp(year=season, month=1, day=1) + pd.Timedelta(days=7 * week)
        rows.append((i, season, 0, week, (season - 2000) * 10 + week - 1, None if i == 5 else day.date(), f"T{h}", f"T{a}", hp, ap, bool(rng.random() < 0.3), int(hp > ap), hp - ap, "fbs", "fbs" if a else "fcs"))
    return rows


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(league(), GAMES)


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame(league(), columns=[c.split()[0] for c in GAMES.split(", ")])


def past(frame, period, rate, back=6):
    h = frame[frame["period"] < period]
    now = h["season"].max()
    h = h[h["season"] >= now - back]
    return h.assign(weight=rate ** (now - h["season"]).astype(float))


def test_history_and_blocks_agree_with_games(games, frame):
    sums, cal = walkforward.pair_sums(games), ratings.calendar(games)
    columns = {"n": ("n", 0.5), "m": ("m", 0.5), "y": ("y", 0.2), "count": ("n", 1.0)}
    plain = walkforward.history(sums, cal, columns, back=1).groupBy("period").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().set_index("period")

    def fit(period, pairs, rows, memory):
        return pd.DataFrame({"period": [period], **{c: [pairs[c].sum()] for c in columns}, "rows": [float(len(rows))]})

    made = walkforward.by_period(sums, cal, columns, games.select("period", "game_id"), fit, "period int, n double, m double, y double, count double, rows double", back=1).toPandas().set_index("period")
    for p in sorted(set(frame["period"]) - {0}):
        h = past(frame, p, 0.5, 1)
        want = (h["weight"].sum(), (h["weight"] * h["margin"].clip(-28, 28)).sum(), (past(frame, p, 0.2, 1)["weight"] * h["home_win"]).sum(), len(h))
        assert tuple(plain.loc[p, list(columns)]) == pytest.approx(want)
        assert tuple(made.loc[p, list(columns)]) == pytest.approx(want) and made.loc[p, "rows"] == (frame["period"] == p).sum()


def test_recency_of_dated_and_undated_games(games, frame):
    cal = ratings.calendar(games)
    pairs = walkforward.history(walkforward.pair_sums(games), cal, {"e": ("e", 1.0), "z": ("z", 1.0)}, 1000).join(walkforward.newest(games, cal), "period")
    got = {r["period"]: (r["w"], r["z"]) for r in pairs.groupBy("period").agg(F.sum(F.col("e") * F.col("scale")).alias("w"), F.sum("z").alias("z")).collect()}
    for p in (3, 17, 29):
        h = frame[(frame["period"] < p)]
        days = (pd.to_datetime(h["start_date"]).max() - pd.to_datetime(h["start_date"])).dt.days.dropna()
        assert got[p] == pytest.approx(((0.5 ** (days / 45)).sum(), 1))


def pairs_of(h):
    g = h.assign(n=h["weight"], y=h["weight"] * h["home_win"], hp=h["weight"] * h["home_points"], ap=h["weight"] * h["away_points"], m=h["weight"] * h["margin"].clip(-28, 28))
    g["h28"], g["a28"] = (np.where(w, h["weight"] * (1 + h["margin"].abs().clip(upper=28)), 0) for w in (h["home_win"] == 1, h["home_win"] == 0))
    return g.groupby(walkforward.PAIR, as_index=False)[["n", "y", "hp", "ap", "m", "h28", "a28"]].sum()


def test_systems_on_pairs_equal_those_on_games(games, frame):
    h = past(frame, 25, 0.35)
    names, s, edge = ratings.bradley_terry_solution(h)
    w = pairs_of(h)
    names2, s2, edge2 = ratings.bradley_terry_solution(w.assign(weight=w["n"], home_win=w["y"] / w["n"]))
    assert list(names) == list(names2) and s == pytest.approx(s2) and edge == pytest.approx(edge2)
    for kind in ratings.EDGE_KINDS:
        spark = games.sparkSession
        e = ratings.edges(spark.createDataFrame(h.drop(columns=["start_date"])).drop("season", "period"), kind, F.col("weight")).toPandas()
        names, r = ratings.pagerank_values(e["src"].to_numpy(str), e["dst"].to_numpy(str), e["w"].to_numpy())
        names2, r2 = walkforward.log_ranks(w, kind)
        assert list(names) == list(names2) and np.log(r) == pytest.approx(r2)


def test_weekly_predictions(games, frame):
    systems = {"ridge": walkforward.ridge_system(), "bt": walkforward.bradley_terry_system(0.65), "pr": walkforward.pagerank_system("points_keep"), "bc": walkforward.blade_chest_system()}
    got = walkforward.weekly(games, systems).toPandas()
    shown = frame[frame["away_division"] == "fbs"]
    assert sorted(got["game_id"]) == sorted(list(shown["game_id"]) * 4)
    early = set(shown[shown["period"] <= 6]["game_id"])  # at most 48 games before
    assert (got[got["game_id"].isin(early)]["p"] == 0.5).all() and got["p"].between(0, 1).all()
    assert got[got["model"] != "ridge"]["margin"].isna().all() and got[(got["model"] == "ridge") & ~got["game_id"].isin(early)]["margin"].notna().all()
    late = shown[shown["period"] == 25].iloc[0]
    names, s, edge = ratings.bradley_terry_solution(past(frame, 25, 0.65))
    value = dict(zip(names, s))
    z = value[late["home_team"]] - value[late["away_team"]] + edge * (not late["neutral_site"])
    assert got[(got["game_id"] == late["game_id"]) & (got["model"] == "bt")]["p"].iloc[0] == pytest.approx(1 / (1 + np.exp(-z)))
    skipped = walkforward.weekly(games, {"ridge": walkforward.ridge_system()}, short=None).toPandas()
    assert not set(skipped["game_id"]) & early


def test_off_def_against_the_dense_fit():
    rng = np.random.default_rng(1)
    t, o, home, w, y = rng.integers(0, 5, 60), rng.integers(5, 9, 60), rng.integers(0, 2, 60).astype(float), rng.random(60) + 0.5, rng.random(60) * 40
    names, off, dfn, level, bonus = ratings.off_def_solution(pd.DataFrame({"team": [f"t{x}" for x in t], "opp": [f"t{x}" for x in o], "home": home, "w": w, "wp": w * y}), 6.0)
    x = np.zeros((60, 20))
    x[np.arange(60), t], x[np.arange(60), 9 + o], x[:, 18], x[:, 19] = 1, -1, 1, home
    z = np.linalg.solve((x * w[:, None]).T @ x + np.diag([6.0] * 18 + [1e-8] * 2), x.T @ (w * y))
    assert np.r_[off, dfn, level, bonus] == pytest.approx(z)


def test_calibration_fit():
    rng = np.random.default_rng(2)
    d, s, y, w = rng.standard_normal(300), rng.integers(0, 2, 300).astype(float), rng.integers(0, 2, 300).astype(float), rng.random(300)
    b = ratings.calibration_fit(d, s, y, w)
    r = w * (y - 1 / (1 + np.exp(-(b[0] + b[1] * d + b[2] * s))))
    assert (r.sum(), (r * d).sum() - b[1], (r * s).sum() - b[2]) == pytest.approx((0, 0, 0), abs=1e-6)
    assert list(ratings.calibration_fit(d, s, np.ones(300), w)) == [30, 0, 0]
    assert len(ratings.calibration_fit(d, None, y, w)) == 2


def test_snapshot_values_and_missing_teams(spark, games, frame):
    shots = snapshot.snapshots(games, snapshot.Settings(least=60)).toPandas()
    assert shots["period"].min() == 8 and set(shots[shots["period"] == 20]["team"]) == {*set(frame["home_team"]), "*"}
    h = past(frame, 20, 0.45, 7)
    both = pd.concat([h[["home_team", "home_points", "weight"]].set_axis(["t", "p", "w"], axis=1), h[["away_team", "away_points", "weight"]].set_axis(["t", "p", "w"], axis=1)])
    one = both[both["t"] == "T3"]
    mean = (one["w"] * one["p"]).sum() / one["w"].sum()
    row = shots[(shots["period"] == 20) & (shots["team"] == "T3")].iloc[0]
    assert row["games"] == pytest.approx(one["w"].sum()) and row["sd"] == pytest.approx(np.sqrt((one["w"] * (one["p"] - mean) ** 2).sum() / one["w"].sum()))
    w = pairs_of(h)
    names, r, _ = ratings.ridge_solution(walkforward.ridge_frame(w, "n", "m"), 4.0)
    assert row["massey_mid"] == pytest.approx(dict(zip(names, r))["T3"])
    new = spark.createDataFrame([(1, 20, "T3", "stranger", True)], "game_id long, period int, home_team string, away_team string, neutral_site boolean")
    f = snapshot.matchups(new, spark.createDataFrame(shots)).first()
    mid = shots[(shots["period"] == 20) & (shots["team"] != "*")]["massey_mid"].median()
    assert f["massey_mid"] == pytest.approx(row["massey_mid"] - mid) and f["home_ind"] == 0.0


def test_scoring_expressions_equal_the_snapshot(games):
    s = snapshot.Settings(least=1)
    pairs = walkforward.history(walkforward.pair_sums(games), ratings.calendar(games), snapshot.columns(s), s.back)
    a = snapshot.scoring(snapshot.by_team(pairs)).toPandas().set_index(["period", "team"])
    b = snapshot.snapshots(games, s).where("team <> '*'").toPandas().set_index(["period", "team"])
    for c in ("pythag", "sd", "games"):
        assert a.loc[b.index, c].to_numpy() == pytest.approx(b[c].to_numpy(), abs=1e-6)


def by_hand(frame, k, mov, early=0, k_early=0.0, own=None):
    r, played, season, out = {}, {}, None, []
    for g in frame.sort_values(["season", "st_order", "week", "start_date", "game_id"]).itertuples():
        if g.season != season:
            season, played = g.season, {}
            r = {t: 1500 + (1 - (own or {}).get((season, t), 0.15)) * (v - 1500) for t, v in r.items()}
        h, a = r.get(g.home_team, 1500.0), r.get(g.away_team, 1500.0)
        p = 1 / (1 + 10 ** (-(h - a + (0 if g.neutral_site else 50)) / 400))
        step = k_early if min(played.get(g.home_team, 0), played.get(g.away_team, 0)) < early else k
        step *= np.log(abs(g.margin) + 1) * 2.2 / (0.001 * (h - a if g.home_win else a - h) + 2.2) if mov else 1
        r[g.home_team], r[g.away_team] = h + step * (g.home_win - p), a - step * (g.home_win - p)
        for t in (g.home_team, g.away_team):
            played[t] = played.get(t, 0) + 1
        out.append((g.game_id, p))
    return dict(out)


def test_elo_variants(spark, games, frame):
    params = spark.createDataFrame([(0, 30.0, 50.0, 0.15, True, 4, 40.0), (1, 40.0, 50.0, 0.15, False, 0, 0.0)], elo.PARAMS)
    got = elo.pregame(games, params).toPandas()
    for k, want in enumerate((by_hand(frame, 30, True, 4, 40.0), by_hand(frame, 40, False))):
        mine = got[got["param_id"] == k].set_index("game_id")["p"].to_dict()
        assert mine == pytest.approx(want)
    own = {(2001, "T1"): 0.6, (2002, "T3"): 0.02}
    regress = spark.createDataFrame([(s, t, v) for (s, t), v in own.items()], "season int, team string, regress double")
    mine = elo.pregame_by_team(games, regress).toPandas().set_index("game_id")["p"].to_dict()
    assert mine == pytest.approx(by_hand(frame, 40, True, own=own))


def test_boosting_and_other_learners():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2500, 5))
    chance = 1 / (1 + np.exp(-2 * ((x[:, 0] > 0) ^ (x[:, 1] > 0)) + 1))
    y = (rng.random(2500) < chance).astype(float)
    x[rng.random(x.shape) < 0.05] = np.nan
    loss = lambda p, y: -(y * np.log(np.clip(p, 1e-12, 1)) + (1 - y) * np.log(np.clip(1 - p, 1e-12, 1))).mean()
    flat = loss(np.full(500, y[:2000].mean()), y[2000:])
    model = boosting.Boosted(150).fit(x[:2000], y[:2000])
    assert loss(model.predict(x[2000:]), y[2000:]) < flat - 0.05
    assert (boosting.Boosted(150).fit(x[:2000], y[:2000]).predict(x) == model.predict(x)).all()
    assert (boosting.Boosted(20, seed=1).fit(x[:2000], y[:2000]).predict(x) != boosting.Boosted(20, seed=2).fit(x[:2000], y[:2000]).predict(x)).any()
    assert loss(boosting.Perceptron().fit(x[:2000], y[:2000]).predict(x[2000:]), y[2000:]) < flat - 0.02
    z = np.nan_to_num(x)
    b = boosting.Logistic(1.0, scale=False).fit(z, y).b
    r = y - 1 / (1 + np.exp(-(b[0] + z @ b[1:])))
    assert np.r_[r.sum(), z.T @ r - b[1:]] == pytest.approx(np.zeros(6), abs=1e-2)
    code = np.zeros((100, 1), np.int64)
    code[:30] = boosting.BINS
    tree = boosting.grown(code, np.r_[np.ones(30), -np.ones(70)], np.ones(100), 1, 1.0, 10)
    assert tree.values[tree.leaves(code)] == pytest.approx(np.r_[np.full(30, -30 / 31), np.full(70, 70 / 71)])


def test_refits_by_season(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(600)
    rows = [(i, 2000 + i // 200, i % 12, int(rng.random() < 1 / (1 + np.exp(-2 * x[i]))), 0, None if i % 50 == 0 else float(x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "game_id long, season int, week int, home_win int, margin int, x double")
    fixed = lambda: boosting.Logistic(1.0)
    got = boosting.refits(df, [boosting.Setting("drop", ("x",), fixed, 150), boosting.Setting("keep", ("x",), lambda: boosting.Boosted(20), 150, drop=False), boosting.Setting("late", ("x",), fixed, 300)]).toPandas()
    assert got.groupby("model")["season"].agg(["min", "count"]).to_dict() == {"min": {"drop": 2001, "keep": 2001, "late": 2002}, "count": {"drop": 392, "keep": 400, "late": 196}}
    b = boosting.bucketed(df, ("x",), ((0, 3), (4, 99)), least=150, few=80).toPandas()
    assert len(b) == 392 and b["p"].between(0, 1).all()
    w = boosting.weights_by_season(df, ("x",), least=150).toPandas()
    assert sorted(w["season"]) == [2001, 2002] and (w["x"] > 1).all()


def test_places_fall_back_and_unknown_ones_are_zero(spark):
    venues = spark.createDataFrame([(2001, "A", 10.0, 20.0, "America/New_York", 5), (2002, "A", 11.0, 20.0, "America/Phoenix", 7), (2001, "B", 40.0, 20.0, "Nowhere", None), (2001, "C", None, 1.0, "America/Boise", 3)], "season int, team string, lat double, lon double, zone string, elev int")
    sides = spark.createDataFrame([(2002, "A"), (2003, "A"), (2003, "B"), (2003, "D")], "season int, team string")
    got = {(r["season"], r["team"]): r["lat"] for r in boxscore.placed(sides, venues).collect()}
    assert got == {(2002, "A"): 11.0, (2003, "A"): 10.0, (2003, "B"): 40.0, (2003, "D"): None}
    cols = "neutral_site boolean, home_lat double, home_lon double, home_zone string, home_elev int, away_lat double, away_lon double, away_zone string, away_elev int"
    trips = spark.createDataFrame([(False, 0.0, 0.0, "America/Boise", 9, 0.0, 90.0, "Nowhere", None), (True, 0.0, 0.0, None, 1, 0.0, 9.0, None, 1), (False, None, 0.0, None, 1, 0.0, 9.0, None, 1), (False, 0.0, 0.0, "America/Anchorage", 1, 0.0, 0.0, "America/Menominee", 1)], cols)
    rows = boxscore.travel(trips).collect()
    assert rows[0]["km"] == pytest.approx(10007.54, abs=0.1) and (rows[0]["tz_diff"], rows[0]["climb"]) == (0, 9)
    assert [(r["km"], r["tz_diff"], r["climb"]) for r in rows[1:]] == [(0, 0, 0), (0, 0, 0), (0, -3, 0)]


def test_continuity_of_a_team_that_lost_all(spark):
    r = spark.createDataFrame([(2000, 1, 10), (2000, 2, 20), (2001, 1, 11), (2001, 2, 20)], "season int, team int, athlete_id long")
    assert {(x["season"], x["team"]): x["roster_continuity"] for x in boxscore.continuity(r).collect()} == {(2001, 1): 0.0, (2001, 2): 1.0}


def test_bands_and_text_values(spark, tmp_path, capsys):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    weeks = (0, 1, 2, 4, 5, 8, 9, 10, 13, 14)
    assert [value(scalar.week_band(F.lit(w))) for w in weeks] == ["1", "1", "2-4", "2-4", "5-9", "5-9", "5-9", "10-13", "10-13", "14+"]
    assert [value(scalar.week_phase(F.lit(w))) for w in (1, 4, 9, 10)] == ["1", "2-4", "5-9", "10+"] and [value(scalar.week_third(F.lit(w))) for w in (3, 4, 9)] == ["0-3", "4-8", "9+"]
    assert (value(tables.numeric(F.lit("1.5"))), value(tables.numeric(F.lit("n/a"))), value(tables.instant(F.lit("soon")))) == (1.5, None, None)
    assert str(value(tables.instant(F.lit("2000-01-02 03:04:05")))) == "2000-01-02 03:04:05"
    (tmp_path / "a_2001.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b_2002.csv").write_text("k\n2\n")
    rows = tables.read_drifting(spark, [str(tmp_path / "a_2001.csv"), str(tmp_path / "b_2002.csv")], ["k int, v string", "k int"]).collect()
    assert sorted((r["k"], r["v"], r["file_year"]) for r in rows) == [(1, "x", 2001), (2, None, 2002)]
    tables.write_csv(spark.range(50), str(tmp_path / "z"), compressed=True)
    assert tables.read_csv(spark, str(tmp_path / "z"), "id long").count() == 50
    assert tables.report(["one", "two"], str(tmp_path / "r.txt")) == "one\ntwo" and (tmp_path / "r.txt").read_text() == "one\ntwo\n"
    assert "two" in capsys.readouterr().out
    assert tables.staged(spark.range(3)).count() == 3


def test_target_ridges_equal_games_weighed_one_by_one(spark, games, frame):
    """Targets of rows that aren't games, some null, one never given: each its own rows and weights."""
    rng = np.random.default_rng(3)
    rows = [(int(r.season), int(r.period), r.home_team, r.away_team, False, float(rng.normal()), None if k % 3 else float(rng.normal()), None) for k, r in enumerate(frame.itertuples()) if k % 2]
    df = spark.createDataFrame(rows, "season int, period int, home_team string, away_team string, neutral_site boolean, x double, y_of double, z double")
    own = pd.DataFrame(rows, columns=["season", "period", "home_team", "away_team", "neutral_site", "x", "y_of", "z"])
    sums, cal = walkforward.with_targets(walkforward.pair_sums(games), df, ("x", "y_of", "z")), ratings.calendar(games)
    assert sums.agg(F.sum("n"), F.sum("n_x"), F.sum("n_y_of"), F.sum("n_z")).first() == (len(frame), len(rows), own["y_of"].count(), 0)
    lam = {"x": 2.0, "y_of": 0.5, "z": 1.0}
    made = walkforward.target_ratings(sums, cal, lam, 0.5, back=1, least=20).toPandas()
    assert set(made["target"]) == {"x", "y_of"}
    newest = {r["period"]: r["hist_season"] for r in cal.collect()}
    for t in ("x", "y_of"):
        for p in sorted(newest):
            h = own[(own["period"] < p) & (own["season"] >= newest[p] - 1)].dropna(subset=[t])
            got = made[(made["target"] == t) & (made["period"] == p)].set_index("team")["rating"]
            if len(h) < 20:
                assert not len(got)
                continue
            names = sorted(set(h["home_team"]) | set(h["away_team"]))
            x = np.zeros((len(h), len(names) + 1))
            x[np.arange(len(h)), [names.index(v) for v in h["home_team"]]] = 1
            x[np.arange(len(h)), [names.index(v) for v in h["away_team"]]] = -1
            x[:, -1] = 1
            w = 0.5 ** (newest[p] - h["season"].to_numpy(float))
            want = np.linalg.solve((x.T * w) @ x + np.diag([lam[t]] * len(names) + [1e-6]), (x.T * w) @ h[t].to_numpy(float))
            assert got[[*names, "*"]].to_numpy() == pytest.approx(want, abs=1e-6)


def test_target_systems_predict_from_rows_and_calibrate_on_games(spark, games, frame):
    exact = [(int(r.season), int(r.period), r.home_team, r.away_team, bool(r.neutral_site), float(np.clip(r.margin, -28, 28)), None) for r in frame.itertuples()]
    df = spark.createDataFrame(exact, "season int, period int, home_team string, away_team string, neutral_site boolean, same double, none double")
    sums = walkforward.with_targets(walkforward.pair_sums(games), df, ("same", "none"))
    systems = {"ridge": walkforward.ridge_system(), "same": walkforward.target_system("same", 4.0), "none": walkforward.target_system("none", 4.0)}
    w = walkforward.weekly(games, systems, sums=sums).toPandas().pivot(index="game_id", columns="model", values=["p", "margin"])
    assert w["p"]["same"].to_numpy() == pytest.approx(w["p"]["ridge"].to_numpy(), abs=1e-6)
    rated = w["margin"]["ridge"].notna()
    assert w["margin"]["same"][rated].to_numpy() == pytest.approx(w["margin"]["ridge"][rated].to_numpy(), abs=1e-6)
    assert (w["p"]["none"] == 0.5).all() and (w["margin"]["none"][rated] == 0).all()


def test_box_weeks_take_the_next_period_of_games(spark, games):
    from paceline.plans import efficiency_queries as q

    rows = spark.createDataFrame([(2000, 1, "a"), (2000, 30, "next season"), (2001, 3, "own"), (2002, 30, "after the last")], "season int, week int, what string")
    own = games.withColumn("st_order", F.lit(0)).select("season", "st_order", "week", "period")
    got = {r["what"]: r["period"] for r in q.clocked(rows, own).collect()}
    of = {(r["season"], r["week"]): n for n, r in enumerate(own.select("season", "week").distinct().orderBy("season", "week").collect())}
    assert got == {"a": of[2000, 1], "next season": of[2001, 1], "own": of[2001, 3]}


def test_ladder_rows_and_lists():
    from paceline.plans import efficiency_queries as q

    rows = [m for ms in q.LADDER.values() for m in ms]
    assert len(rows) == len(set(rows)) == 22
    assert {m for ms in q.STACKS.values() for m in ms} <= {*rows, *q.BASE} and set(q.TIERS) | set(q.STACKS) <= set(rows)


def test_no_history_is_shuffled_by_period(games):
    """Blocks scan the stored sums, and sums by team are stepped through: neither moves a row once a period."""
    sums, cal = walkforward.pair_sums(games), ratings.calendar(games)
    columns = {"n": ("n", 0.5), "m": ("m", 0.5), "count": ("n", 1.0)}
    fit = lambda period, pairs, rows, memory: pd.DataFrame({"period": [period], "n": [pairs["n"].sum()]})
    made = walkforward.by_period(sums, cal, columns, cal.select("period"), fit, "period int, n double")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.rdd.getNumPartitions() == walkforward.blocked(cal).select("block").distinct().count()  # a task a block
    steps = walkforward.steps(sums, cal, ["home_team"], columns, back=1)
    seasons = cal.select("hist_season").distinct().count()
    assert steps.count() <= 2 * sums.select("season", "period", "home_team").distinct().count() and steps.where("since = -1").count() <= 8 * seasons
    got = walkforward.running(steps, cal, ["home_team"], list(columns)).toPandas().set_index(["period", "home_team"]).sort_index()
    want = walkforward.history(sums, cal, columns, back=1).groupBy("period", "home_team").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().set_index(["period", "home_team"]).sort_index()
    pd.testing.assert_frame_equal(got, want)
