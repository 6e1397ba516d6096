"""What walk-forward passes leave on disk: no shuffle of games, no rows a team and period, no shuffle files of what is stored."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceline.operators import boosting, ratings, snapshot, walkforward
from paceline.plans import efficiency_queries, walkforward_queries
from paceline.sources import tables
from test_walkforward import GAMES, league

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(league(), GAMES)


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for k in range(files.size()) if (f := files.apply(k).getName()).startswith("shuffle_")}


@pytest.mark.parametrize("kept", [tables.stored, tables.staged])
def test_what_is_stored_leaves_no_shuffle_files(spark, kept):
    before = shuffle_files(spark)
    df = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert not shuffle_files(spark) - before
    assert df.agg(F.sum("s")).first()[0] == 499500 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_weekly_shuffles_no_game(games, monkeypatch):
    plans = []

    def kept(df, *by):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.stored(df, *by)

    monkeypatch.setattr(walkforward, "stored", kept)
    made = walkforward.weekly(games, {"ridge_margin": walkforward.ridge_system()})
    assert len(plans) == 2 and "hashpartitioning(season" not in plans[0]  # sums by pair were aggregated before
    assert made.where("p is not null").count() == walkforward.evaluated(games).count()


def test_values_of_games_are_sums_by_pair_in_blocks(games):
    cal, columns = ratings.calendar(games), {"m": ("m", 0.5), "n": ("n", 1.0), "e": ("e", 0.4)}
    fit = lambda period, pairs, rows, memory: pd.DataFrame({"period": period, "home": pairs["home_team"].astype(str), "away": pairs["away_team"].astype(str), "neutral": pairs["neutral_site"].astype(float), **{c: pairs[c] for c in columns}})
    schema = "period int, home string, away string, neutral double, m double, n double, e double"
    got, want = (walkforward.by_period(s, cal, columns, cal.select("period"), fit, schema).toPandas().sort_values(["period", "home", "away", "neutral"]).reset_index(drop=True) for s in (walkforward.pair_values(games), walkforward.pair_sums(games)))
    pd.testing.assert_frame_equal(got, want)


def test_features_in_tasks_are_matchups(games):
    s, new = snapshot.Settings(least=60), walkforward.evaluated(games)
    made = snapshot.features(games, s)
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()  # ratings were joined by team and period
    want = snapshot.matchups(new.select("game_id", "season", "period", "home_team", "away_team", "neutral_site"), tables.staged(snapshot.snapshots(games, s)))
    got, want = (df.select("game_id", "season", "period", *snapshot.FEATURES).toPandas().sort_values("game_id").reset_index(drop=True) for df in (made, want))
    assert len(got) > 80
    pd.testing.assert_frame_equal(got, want)


def test_a_team_without_ratings_takes_medians():
    shots = pd.DataFrame({"team": ["A", "B", "C", "*"], **{v: [1.0, 3.0, None, 0.5] for v in snapshot.VALUES}})
    games = pd.DataFrame({"game_id": [1, 2], "home_team": ["Z", "C"], "away_team": ["A", "B"], "neutral_site": [True, False]})
    made = snapshot.matched(shots, games)
    assert made["pr_diff"].tolist() == [1.0, -1.0] and made["bt_diff"].tolist() == [1.0, -0.5] and made["gpw_min"].tolist() == [1.0, 2.0]


def test_weights_by_season_shuffle_no_row(spark):
    df = spark.createDataFrame([(i, 2000 + i // 100, i % 2, float((i * 7 % 10) / 10)) for i in range(400)], "game_id long, season int, home_win int, x double")
    made = boosting.weights_by_season(df, ("x",), least=150)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["season"], r["n"]) for r in made.collect()) == [(2002, 200), (2003, 300)]


def test_lines_are_ranked_once_and_seasons_are_no_join_of_games(spark, games):
    plan = walkforward_queries.spreads(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan
    preds = games.select("game_id", "period", F.lit(0.5).alias("p"))
    made = walkforward_queries.with_seasons(preds, games)
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r["game_id"], r["season"]) for r in made.collect()} == {(r["game_id"], r["season"]) for r in games.collect()}


def test_efficiency_metrics_fit_ridges_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(efficiency_queries.walkforward, "weekly", lambda g, systems, **_: asked.extend(systems) or g.select(F.lit("ridge").alias("model"), F.lit(0.5).alias("p"), "home_win"))
    efficiency_queries.efficiency_metrics(spark, SF)
    assert len(asked) == 6 and all(name.startswith("ridge_") for name in asked)
