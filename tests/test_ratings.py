"""Ratings: specified edge shares, invariants, independent formulations."""

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from paceline.operators import elo, ratings
from paceline.sources import tables

THREE = [("T", "A", 5, 3), ("T", "B", 8, 10), ("T", "C", 7, 7)]


@pytest.mark.parametrize(
    ("kind", "shares"),
    [("points_against", {"A": 15.0, "B": 50.0, "C": 35.0}), ("points_keep", {"A": 7.5, "B": 25.0, "C": 17.5, "T": 50.0})],
)
def test_outflow_shares(spark, kind, shares):
    g = spark.createDataFrame(THREE, "home_team string, away_team string, home_points int, away_points int")
    rows = ratings.edges(g, kind).where("src = 'T'").groupBy("dst").agg(F.sum("w").alias("w")).collect()
    total = sum(r["w"] for r in rows)
    assert {r["dst"]: 100 * r["w"] / total for r in rows} == pytest.approx(shares)


def test_games_counts(spark):
    g = tables.timed_games(spark, SF)
    r = g.agg(F.count("*").alias("n"), F.count_if("neutral_site").alias("neutral"), F.max("period").alias("p"), F.count_if(F.col("season_type") == "postseason").alias("post"), F.avg("home_win").alias("w")).first()
    assert (r["n"], r["neutral"], r["p"] + 1, r["post"], round(r["w"], 4)) == (1229, 408, 335, 80, 0.4817)


def test_pagerank_against_linear_solve():
    rng = np.random.default_rng(1)
    src, dst, w = rng.integers(0, 12, 80), rng.integers(0, 12, 80), rng.random(80)
    dst[src == 3] = 3
    src = np.where(src == 5, 4, src)  # 5 has no outflow
    names, r = ratings.pagerank_values(src, dst, w)
    n = len(names)
    m = np.zeros((n, n))
    for s, d, x in zip(np.searchsorted(names, src), np.searchsorted(names, dst), w):
        m[d, s] += x
    out = m.sum(0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / n)
    exact = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    assert r.sum() == pytest.approx(1)
    assert r == pytest.approx(exact, abs=1e-8)


@pytest.mark.parametrize("hub", [100_000, 8])
def test_pagerank_by_joins(spark, hub):
    """Nodes without outflow, loops, parallel edges, and hubs dealt out to parts: the ranks of the power iteration in one array."""
    rng = np.random.default_rng(2)
    src, dst, w = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.random(200) + 0.1
    src[:40] = 7
    src = np.where((src == 5) | (src == 9), 4, src)
    e = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(x)) for a, b, x in zip(src, dst, w)], "src string, dst string, w double")
    for rounds in (7, 200):
        names, want = ratings.pagerank_values(np.array([f"n{x:02d}" for x in src]), np.array([f"n{x:02d}" for x in dst]), w, rounds=rounds)
        got = {r["team"]: r["rank"] for r in ratings.pagerank_joined(e, rounds=rounds, hub=hub).collect()}
        assert got == pytest.approx(dict(zip(names, want)), abs=1e-9)
    assert ratings.pagerank_joined(e.where("false")).collect() == []


def test_pagerank_rounds_read_pieces(spark, monkeypatch):
    """What rounds read is pieces of many edges and an array a part: a row an edge before."""
    rng = np.random.default_rng(4)
    e = spark.createDataFrame([(f"n{a}", f"n{b}", 1.0) for a, b in rng.integers(0, 40, (2000, 2)).tolist()], "src string, dst string, w double")
    rows, staged = [], ratings.staged
    monkeypatch.setattr(ratings, "staged", lambda df: rows.append(staged(df)) or rows[-1])
    assert ratings.pagerank_joined(e, rounds=3).count() == 40
    assert max(df.count() for df in rows if "w" not in df.columns) <= 40


def league(n=400, teams=9, seed=0):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, teams, n)
    a = (h + rng.integers(1, teams, n)) % teams
    m = rng.integers(1, 30, n) * rng.choice([-1, 1], n)
    return pd.DataFrame({"season": np.arange(n) // 100, "st_order": 0, "week": np.arange(n) % 100, "start_date": pd.Timestamp("2000-01-01"), "game_id": np.arange(n), "home_team": [f"S{x}" for x in h], "away_team": [f"S{x}" for x in a], "home_win": (m > 0).astype(int), "margin": m, "neutral_site": rng.random(n) < 0.3, "weight": rng.random(n)})


def plain_elo(g, k, hfa, reg):
    r, out, season = {}, [], None
    for x in g.itertuples():
        if season is not None and x.season != season:
            r = {t: 1500 + (1 - reg) * (v - 1500) for t, v in r.items()}
        season = x.season
        a, b = r.get(x.home_team, 1500.0), r.get(x.away_team, 1500.0)
        p = 1 / (1 + 10 ** (-(a - b + (0 if x.neutral_site else hfa)) / 400))
        wd = a - b if x.home_win else b - a
        d = k * np.log(abs(x.margin) + 1) * 2.2 / (0.001 * wd + 2.2) * (x.home_win - p)
        r[x.home_team], r[x.away_team] = a + d, b - d
        out.append(p)
    return out, r


def test_elo_against_plain_loop_and_zero_sum():
    g = league()
    h, a, p, final = elo.play(g, 40.0, 50.0, 0.15, True)
    q, r = plain_elo(g, 40.0, 50.0, 0.15)
    assert p == pytest.approx(q)
    assert final == pytest.approx(r)
    one = g[g["season"] == 0]
    assert sum(elo.play(one, 40.0, 50.0, 0.15, True)[3].values()) == pytest.approx(1500 * 9)


def test_elo_wavefronts():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 12, 300)
    a = (h + rng.integers(1, 12, 300)) % 12
    seen = np.zeros(300, int)
    fronts = list(elo.fronts(h, a, 12))
    for k, at in enumerate(fronts):
        sides = np.r_[h[at], a[at]]
        assert len(set(sides)) == len(sides) and (np.diff(at) > 0).all()
        seen[at] = k + 1
    assert sorted(np.concatenate(fronts)) == list(range(300))
    for i in range(300):
        earlier = [seen[j] for j in range(i) if {h[j], a[j]} & {h[i], a[i]}]
        assert seen[i] == max(earlier, default=0) + 1


def test_elo_spans_hand_ratings_on(spark):
    """Many spans, more sets than a task plays, teams' own shares: as one pass over all games."""
    g = league(600)
    df = spark.createDataFrame(g.drop(columns=["weight"], errors="ignore"))
    params = elo.grid(spark)
    whole = elo.pregame(df, params).toPandas().set_index(["param_id", "game_id"]).sort_index()
    cut = elo.pregame(df, params, size=150).toPandas().set_index(["param_id", "game_id"]).sort_index()
    assert len(whole) == 45 * 600 and (whole.index == cut.index).all() and np.abs(whole.to_numpy() - cut.to_numpy()).max() < 1e-9
    q, r = plain_elo(g, 40.0, 65.0, 0.10)
    k = [i for i, x in enumerate(params.collect()) if (x["k"], x["hfa"], x["regress"]) == (40.0, 65.0, 0.10)][0]
    assert cut.loc[k]["p"].to_numpy() == pytest.approx(q)
    ends = {x["team"]: x["rating"] for x in elo.final(df, params.where(f"param_id = {k}"), size=150).collect()}
    assert ends == pytest.approx(r)
    shares = spark.createDataFrame([(2, "S1", 0.5), (4, "S3", 0.02)], "season int, team string, regress double")
    a, b = (elo.pregame_by_team(df, shares, size=n).toPandas().set_index("game_id").sort_index() for n in (150, 10_000))
    assert np.abs(a.to_numpy() - b.to_numpy()).max() < 1e-9
    assert elo.pregame(df.where("false"), params).collect() == [] == elo.final(df.where("false"), params).collect()


def test_elo_doesnt_see_the_future():
    g = league()
    changed = g.copy()
    changed.loc[200:, "home_win"] = 1 - changed.loc[200:, "home_win"]
    assert elo.play(g, 40.0, 50.0, 0.15, True)[2][:201] == pytest.approx(elo.play(changed, 40.0, 50.0, 0.15, True)[2][:201])


def test_ridge_residual_is_zero():
    g = league()
    s = g.assign(w=g["weight"], wi=g["weight"] * ~g["neutral_site"], wy=g["weight"] * g["margin"], wiy=g["weight"] * ~g["neutral_site"] * g["margin"])
    names, r, hfa = ratings.ridge_solution(s, 4.0)
    ix = {t: i for i, t in enumerate(names)}
    x = np.zeros((len(g), len(names) + 1))
    for k, (h, a, neutral) in enumerate(zip(g["home_team"], g["away_team"], g["neutral_site"])):
        x[k, ix[h]], x[k, ix[a]], x[k, -1] = 1, -1, 0 if neutral else 1
    w = g["weight"].to_numpy()
    pen = np.r_[np.full(len(names), 4.0), 1e-6]
    grad = x.T @ (w * (g["margin"].to_numpy() - x @ np.r_[r, hfa])) - pen * np.r_[r, hfa]
    assert np.abs(grad).max() < 1e-8


def test_bradley_terry_gradient_is_zero():
    g = league()
    names, s, edge = ratings.bradley_terry_solution(g)
    ix = {t: i for i, t in enumerate(names)}
    h, a = g["home_team"].map(ix), g["away_team"].map(ix)
    p = 1 / (1 + np.exp(-(s[h] - s[a] + edge * ~g["neutral_site"])))
    res = (g["weight"] * (g["home_win"] - p)).to_numpy()
    grad = np.bincount(h, res, len(names)) - np.bincount(a, res, len(names)) - 3.0 * s
    assert np.abs(grad).max() < 1e-6


def test_blade_chest_gradient_matches_differences():
    g = league(60)
    names, flat = np.unique(np.r_[g["home_team"], g["away_team"]], return_inverse=True)
    args = (flat[:60], flat[60:], 1.0 - g["neutral_site"].to_numpy(float), g["home_win"].to_numpy(float), g["weight"].to_numpy(), len(names), 3, 1.0)
    x = np.random.default_rng(0).standard_normal(7 * len(names) + 1) * 0.2
    _, grad = ratings.blade_chest_loss(x, *args)
    for k in (0, 5, len(x) - 1, len(x) - 3):
        e = np.zeros_like(x)
        e[k] = 1e-6
        assert grad[k] == pytest.approx((ratings.blade_chest_loss(x + e, *args)[0] - ratings.blade_chest_loss(x - e, *args)[0]) / 2e-6, abs=1e-4)
    y = ratings.minimise(lambda v: ratings.blade_chest_loss(v, *args), x)
    assert np.abs(ratings.blade_chest_loss(y, *args)[1]).max() < 1e-3


def test_incremental_history_equals_range_join(spark):
    g = tables.timed_games(spark, SF)
    cal = ratings.calendar(g)
    stats = g.groupBy("season", "period", "home_team").agg(F.sum("margin").cast("double").alias("m"), F.sum(F.lit(1.0)).alias("n"))
    fast = ratings.history_sums(stats, cal, ["home_team"], ["m", "n"], 0.35, 2)
    plain = ratings.history_join(g, cal, 0.35, 2).groupBy(F.col("at").alias("period"), "home_team").agg(F.sum(F.col("weight") * F.col("margin")).alias("m2"), F.sum("weight").alias("n2"))
    both = fast.join(plain, ["period", "home_team"], "full")
    assert both.where("m is null or m2 is null or abs(m - m2) > 1e-7 or abs(n - n2) > 1e-9").count() == 0


def first_season(module, monkeypatch):
    monkeypatch.setattr(module, "timed_games", lambda spark, sf: tables.timed_games(spark, sf).where("season <= 1995"))


def test_tuning_scores_every_period(spark, monkeypatch):
    from paceline.plans import walkforward_queries as q

    first_season(q, monkeypatch)
    n = q.timed_games(spark, SF).where("home_division = 'fbs' and away_division = 'fbs'").count()
    rows = q.decay_tuning(spark, SF).collect()
    assert {(r["family"], r["decay"]) for r in rows} == {(f, d) for f in ("pr_points_keep", "bradley_terry") for d in (0.0, 0.35, 0.5, 0.65, 0.8, 1.0)}
    assert {r["n"] for r in rows} == {n} and sum(r["best"] for r in rows) == 2


def test_season_queries_take_all_seasons(spark, monkeypatch):
    from paceline.operators import models
    from paceline.plans import rating_queries as q

    n = {r["season"]: r["count"] for r in q._features(spark, SF).groupBy("season").count().collect()}
    want = {s for s in n if sum(v for k, v in n.items() if k < s) >= models.MIN_TRAIN}
    assert len(want) > 2
    assert {r["season"]: r["count"] for r in q.season_lr(spark, SF).groupBy("season").count().collect()} == {s: n[s] for s in want}
    asked = []
    monkeypatch.setattr(models, "season_refits", lambda f, names, make, seasons=None, least=0: asked.append((seasons, make(900)[-1])) or spark.range(0).selectExpr("id as game_id", "1 as season", "0.5D as p"))
    for f in (q.season_gbm, q.season_mlp):
        f(spark, SF)
    assert all(s is None for s, _ in asked) and [m.getMaxIter() for _, m in asked] == [50, 100]


def test_calibrated_prob_takes_all_periods(spark, monkeypatch):
    from paceline.plans import rating_queries as q

    first_season(q, monkeypatch)
    g = q.timed_games(spark, SF).where("home_division = 'fbs' and away_division = 'fbs'")
    assert q.calibrated_prob(spark, SF).count() == g.count() > 0


def test_rankers_rate_every_period(spark, monkeypatch):
    from paceline.plans import rating_queries as q

    g = tables.timed_games(spark, SF).where("period < 14")
    monkeypatch.setattr(q, "timed_games", lambda spark, sf: g)
    want = {r["period"] for r in ratings.calendar(g).collect()}
    assert len(want) > 5
    for f in (q.bradley_terry, q.blade_chest, q.offense_defense_ratings):
        assert {r["period"] for r in f(spark, SF).select("period").collect()} == want, f.__name__
    enough = {p for p in want if g.where(f"period < {p}").count() >= 50}
    assert {r["period"] for r in q.massey_ratings(spark, SF).select("period").collect()} == enough
