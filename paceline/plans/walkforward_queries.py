"""Queries of walk-forward rating systems, result-based features, season refits, stacks and tuning."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import logit, sigmoid
from paceline.operators import boosting, boxscore, elo, evaluate, form, lines, ratings, snapshot, walkforward
from paceline.operators.boosting import Boosted, Logistic, MarginBoosted, Perceptron, Setting
from paceline.plans.oracle import BOX, CALENDAR, GAMES, PLAYS, SNAPSHOT_SUMS
from paceline.plans.registry import query
from paceline.sources.tables import games, line_odds, plays, rosters, six, staged, stored, timed_games

#: Feature sets of the result-based models.
RATING = (*snapshot.FEATURES, "elo_diff", "elo_fast_diff", "elo_slow_diff")
FORM = ("wp_diff", "avgmargin_diff", "form3_diff", "gp_min", "gp_diff", "rest_diff", "neutral", "week")
NEWER = ("massey_cap14", "massey_cap50", "massey_recent", "scoresd_sum", "scoresd_diff", "gpw_min")
SETS = {
    "all": (*RATING, *FORM, "h2h_margin", "h2h_n"),
    "orig": tuple(f for f in (*RATING, *FORM) if f not in NEWER),
    "compact": ("massey_short", "massey_mid", "offdef_margin", "offdef_total", "elo_diff", "bt_diff", "pr_diff", "sos_diff", "wp_diff", "form3_diff", "gp_min", "rest_diff", "neutral", "home_ind", "week"),
    "ratings": RATING,
}
LINEAR = ("massey_mid", "offdef_margin", "bt_diff", "elo_diff", "pr_diff", "home_ind")
#: Fixed values of the tuning grids: depth, step, rounds; decays of ratings; blend weights.
GRIDS = {"d3_lr04": (3, 0.04, 400), "d3_lr03_600": (3, 0.03, 600), "d4_lr03": (4, 0.03, 500), "d2_lr05": (2, 0.05, 700)}
RATES = (0.0, 0.35, 0.5, 0.65, 0.8, 1.0)
SLOPES = (0.0, 0.3, 0.6, 0.9, 1.2)
BLENDS = (0.0, 0.25, 0.5, 0.75, 1.0)
SWEEP = {
    "base": snapshot.Settings(), "cap21": snapshot.Settings(cap=21.0), "cap35": snapshot.Settings(cap=35.0), "lam8": snapshot.Settings(lam=8.0), "lam2": snapshot.Settings(lam=2.0),
    "decay_lo": snapshot.Settings(decays=(0.15, 0.35, 0.70)), "decay_hi": snapshot.Settings(decays=(0.30, 0.55, 0.90)),
    "cap35_lam2": snapshot.Settings(cap=35.0, lam=2.0), "cap35_dhi": snapshot.Settings(cap=35.0, decays=(0.30, 0.55, 0.90)),
}
#: The ten features of the plain season models.
PLAIN = ("elo_prob", "elo_diff", "home_ind", "neutral", "conf_game", "wp_diff", "avgmargin_diff", "gp_home", "gp_away", "rest_diff")


def pool(g: DataFrame) -> DataFrame:
    """Games with at least one side of the first division."""
    return g.where("home_division = 'fbs' or away_division = 'fbs'")


def tuned(spark, *ks: float) -> DataFrame:
    return spark.createDataFrame([(i, k, 50.0, 0.15, True, 0, 0.0) for i, k in enumerate(ks)], elo.PARAMS)


def skeleton(spark, sf) -> DataFrame:
    """The predicted games with Elo of three speeds and form: all but the ratings of a snapshot."""
    own = pool(timed_games(spark, sf))
    speeds = elo.pregame(own, tuned(spark, 20.0, 40.0, 65.0)).withColumn("d", F.col("home_elo") - F.col("away_elo"))
    speeds = speeds.groupBy("game_id").agg(*[F.max(F.when(F.col("param_id") == k, F.col("d"))).alias(n) for k, n in enumerate(("elo_slow_diff", "elo_diff", "elo_fast_diff"))], F.max(F.when(F.col("param_id") == 1, F.col("p"))).alias("elo_prob"))
    f = form.game_form(own).select("game_id", F.col("win_pct_diff").alias("wp_diff"), F.col("avg_margin_diff").alias("avgmargin_diff"), F.col("last3_diff").alias("form3_diff"), "gp_min", "gp_diff", "rest_diff", F.col("home_gp").alias("gp_home"), F.col("away_gp").alias("gp_away"))
    keep = ("game_id", "season", "period", "week", "season_type", "home_team", "away_team", "neutral_site", "conference_game", "home_win", "margin")
    base = walkforward.evaluated(own).select(*keep, F.col("neutral_site").cast("double").alias("neutral"), F.col("conference_game").cast("double").alias("conf_game"))
    return base.join(speeds, "game_id", "left").join(f, "game_id", "left").join(form.head_to_head(own), "game_id", "left")


def features(spark, sf, settings: snapshot.Settings = snapshot.Settings(), base: DataFrame | None = None) -> DataFrame:
    """The result-based feature table: one row a predicted game whose period has enough history."""
    made = snapshot.features(pool(timed_games(spark, sf)), settings)
    return (skeleton(spark, sf) if base is None else base).join(made.select("game_id", *snapshot.FEATURES), "game_id")


def scored(preds: DataFrame, *by: str) -> DataFrame:
    m = evaluate.metrics(preds, *by)
    return m.select(*by, "model", "n", six(F.col("acc")).alias("acc"), six(F.col("logloss")).alias("logloss"), six(F.col("brier")).alias("brier"))


def halves(preds: DataFrame) -> DataFrame:
    """``preds`` with ``part``: validation up to the middle of the predicted seasons, test after it."""
    mid = preds.agg(((F.min("season") + F.max("season")) / 2).alias("mid"))
    return preds.join(F.broadcast(mid)).withColumn("part", F.when(F.col("season") <= F.col("mid"), "val").otherwise("test")).drop("mid")  # one row


def chosen(preds: DataFrame) -> DataFrame:
    """Log loss of each model in both parts, and which is best on validation, the first by name of equal ones."""
    m = evaluate.metrics(halves(preds), "part").groupBy("model").pivot("part", ["val", "test"]).agg(F.first("logloss").alias("ll"), F.first("acc").alias("acc"), F.first("n").alias("n"))
    best = F.min(F.struct("val_ll", "model")).over(Window.partitionBy(F.lit(0)))["model"]  # a row a model
    return m.select("model", "val_n", six(F.col("val_ll")).alias("val_ll"), "test_n", six(F.col("test_ll")).alias("test_ll"), six(F.col("test_acc")).alias("test_acc"), (F.col("model") == best).alias("best"))


def blended(a: DataFrame, b: DataFrame, weight: float, name: str) -> DataFrame:
    """``weight`` of the log-odds of ``a`` and the rest of ``b``'s, for games that both predict."""
    both = a.select("game_id", "season", "home_win", F.col("p").alias("pa")).join(b.select("game_id", F.col("p").alias("pb")), "game_id")
    return both.select(F.lit(name).alias("model"), "game_id", "season", "home_win", sigmoid(weight * logit(F.col("pa")) + (1 - weight) * logit(F.col("pb"))).alias("p"))


def averaged(preds: DataFrame, name: str) -> DataFrame:
    """The mean of the models' log-odds for games."""
    return preds.groupBy("game_id", "season", "home_win").agg(sigmoid(F.avg(logit(F.col("p")))).alias("p")).select(F.lit(name).alias("model"), "game_id", "season", "home_win", "p")


# Weekly passes


@query()
def weekly_predictions(spark, sf):
    """Every rating system refitted for every period: chances of the games within the first division."""
    systems = {name: make() for name, make in walkforward.SYSTEMS.items()}
    w = walkforward.weekly(timed_games(spark, sf), systems)
    return w.select("model", "game_id", "period", "home_win", six(F.col("p")).alias("p"), six(F.col("margin")).alias("margin"))


@query()
def weekly_metrics(spark, sf):
    """Scores of the rating systems, refitted for every period; Blade-Chest is in ``weekly_predictions``."""
    systems = {name: make() for name, make in walkforward.SYSTEMS.items() if name != "blade_chest"}
    return scored(walkforward.weekly(timed_games(spark, sf), systems))


@query()
def collected_margins(spark, sf):
    """Ridge margins and chances by week for periods with enough history only."""
    w = walkforward.weekly(timed_games(spark, sf), {"ridge_margin": walkforward.ridge_system()}, short=None)
    return w.select("game_id", "period", six(F.col("p")).alias("p"), six(F.col("margin")).alias("margin"))


@query()
def log_ranks(spark, sf):
    """Log-ranks of points kept by period: the walk-forward twin of ``pagerank_fixed_iter``."""
    g = timed_games(spark, sf)
    cal = ratings.calendar(g)

    def fit(period, pairs, _, memory):
        names, ranks = walkforward.log_ranks(pairs, "points_keep")
        return pd.DataFrame({"period": period, "team": names, "log_rank": ranks})

    made = walkforward.by_period(walkforward.pair_values(g), cal, {c: (c, 0.35) for c in ("n", "y", "hp", "ap")}, cal.select("period"), fit, "period int, team string, log_rank double", whole=False)
    return made.withColumn("log_rank", six(F.col("log_rank")))


@query(CALENDAR + """, p AS (SELECT c.period, t.home_team, t.away_team, t.neutral_site, sum(pow(0.35, c.hist_season - t.season)) AS n, sum(pow(0.35, c.hist_season - t.season) * home_win) AS y,
        sum(pow(0.35, c.hist_season - t.season) * least(greatest(margin, -28), 28)) AS m FROM cal c JOIN t ON t.period < c.period AND t.season >= c.hist_season - 6 GROUP BY ALL)
    SELECT period, home_team AS team, count(*) AS pairs, round(sum(n) + 1e-8, 5) AS n, round(sum(y) + 1e-8, 5) AS y, round(sum(m) + 1e-7, 4) + 0.0 AS m FROM p GROUP BY period, home_team""")
def history_pairs(spark, sf):
    """What every system is fitted on: the decayed sums of a period's history by pair, here summed by home team.

    Powers of the decay end in 5, so sums lie on roundings' edges: a little is added before."""
    g = timed_games(spark, sf)
    cal, sums = ratings.calendar(g), ("n", "y", "m")
    made = walkforward.steps(walkforward.pair_sums(g), cal, walkforward.PAIR, {c: (c, 0.35) for c in sums})
    new = F.row_number().over(Window.partitionBy("hist_season", *walkforward.PAIR).orderBy("since")) == 1  # a pair counts once a season
    made = made.withColumn("pairs", new.cast("long")).groupBy("hist_season", "since", F.col("home_team").alias("team")).agg(*[F.sum(c).alias(c) for c in ("pairs", *sums)])
    made = walkforward.running(made, cal, ["team"], ["pairs", *sums])
    return made.select("period", "team", "pairs", F.round(F.col("n") + 1e-8, 5).alias("n"), F.round(F.col("y") + 1e-8, 5).alias("y"), (F.round(F.col("m") + 1e-7, 4) + 0.0).alias("m"))


@query()
def pagerank_tuning(spark, sf):
    """Margin caps and dampings of PageRank by log loss over all predicted periods."""
    systems = {f"cap{cap}_damping{d}": walkforward.pagerank_system(f"margin{cap}", damping=d) for cap in (14, 28, 45) for d in (0.85, 0.90)}
    g = timed_games(spark, sf)
    return chosen(with_seasons(walkforward.weekly(g, systems), g))


@query()
def decay_tuning(spark, sf):
    """Six decays of two families by log loss over every period; all earlier games inform, back to the first season."""
    systems = {f"pr_points_keep@{r}": walkforward.pagerank_system("points_keep", r) for r in RATES} | {f"bradley_terry@{r}": walkforward.bradley_terry_system(r) for r in RATES}
    w = walkforward.weekly(timed_games(spark, sf), systems, back=1000)
    m = evaluate.metrics(w).withColumns({"family": F.split_part("model", F.lit("@"), F.lit(1)), "decay": F.split_part("model", F.lit("@"), F.lit(2)).cast("double")})
    best = F.min(F.struct("logloss", "decay")).over(Window.partitionBy("family"))["decay"]  # a row a decay
    return m.select("family", "decay", "n", six(F.col("acc")).alias("acc"), six(F.col("logloss")).alias("logloss"), (F.col("decay") == best).alias("best"))


# Snapshots and features


@query()
def snapshot_ratings(spark, sf):
    """All result-based ratings of every period with a hundred games of history."""
    s = snapshot.snapshots(pool(timed_games(spark, sf)))
    return s.select("period", "team", *[six(F.col(v)).alias(v) for v in snapshot.VALUES])


@query(SNAPSHOT_SUMS + """ SELECT period, team, round(pow(greatest(pf, 1e-6), 2.37) / (pow(greatest(pf, 1e-6), 2.37) + pow(greatest(pa, 1e-6), 2.37)), 6) AS pythag,
    round(sqrt(greatest(sq / greatest(n, 1e-6) - pow(pf / greatest(n, 1e-6), 2), 0)), 4) AS sd, round(n + 1e-9, 6) AS games FROM sums""")
def pythagorean_expectation(spark, sf):
    """Expectation, deviation of points scored, and effective games of every team in every period."""
    g = pool(timed_games(spark, sf))
    s, cal, names = snapshot.Settings(), ratings.calendar(g), ["n", "pf", "pa", "sq"]
    teams = snapshot.by_team(walkforward.pair_sums(g).withColumnRenamed("n", "n1"), "season", "period")
    teams = walkforward.steps(teams, cal, ["team"], {k: (k, s.decays[1]) for k in names}, s.back)
    return snapshot.scoring(walkforward.running(teams, cal, ["team"], names)).select("period", "team", six(F.col("pythag")).alias("pythag"), F.round("sd", 4).alias("sd"), six(F.col("games") + 1e-9).alias("games"))


@query(SNAPSHOT_SUMS + """, r AS (SELECT period, any_value(ref) AS ref, home_team AS team, count(*) AS n, round(sum(pow(0.45, hist_season - season) * pow(0.5, date_diff('day', start_date, ref) / 45)), 3) AS weight,
        round(sum(pow(0.45, hist_season - season) * pow(0.5, date_diff('day', start_date, ref) / 45) * least(greatest(margin, -28), 28)), 3) + 0.0 AS margin FROM w GROUP BY period, home_team)
    SELECT period, team, n, weight, margin FROM r""")
def massey_recent_weights(spark, sf):
    """Sums of the recent-form ridge by home team and period: season decay and a half-life of 45 days from the newest game."""
    g = pool(timed_games(spark, sf))
    cal, s = ratings.calendar(g), snapshot.Settings()
    made = walkforward.steps(walkforward.pair_sums(g, by=["home_team"]), cal, ["home_team"], {"n": ("n", 1.0), "e": ("e", s.decays[1]), "em": ("em", s.decays[1])}, s.back)
    made = walkforward.running(made, cal, ["home_team"], ["n", "e", "em"]).join(F.broadcast(walkforward.newest(g, cal)), "period")  # a row a period
    out = made.select("period", F.col("home_team").alias("team"), F.col("n").cast("long").alias("n"), (F.col("e") * F.col("scale")).alias("weight"), (F.col("em") * F.col("scale")).alias("margin"))
    return out.select("period", "team", "n", F.round("weight", 3).alias("weight"), (F.round("margin", 3) + 0.0).alias("margin"))


@query()
def strength_of_schedule(spark, sf):
    """The decayed mean of the opponents' ridge ratings, every period."""
    return snapshot.snapshots(pool(timed_games(spark, sf))).where("team <> '*'").select("period", "team", six(F.col("sos")).alias("sos"))


@query()
def matchup_features(spark, sf):
    """The sixteen rating features of every predicted game."""
    x = snapshot.features(pool(timed_games(spark, sf)))
    return x.select("game_id", "season", "period", *[six(F.col(f)).alias(f) for f in snapshot.FEATURES])


# Season refits


def result_settings(seeds: int = 5) -> list[Setting]:
    # The boosted model's depth, step, rounds and leaf; the linear model's features.
    gbm = [Setting(f"gbm{s}", SETS["all"], lambda s=s: Boosted(400, 3, 0.04, leaf=40, seed=s), 2000) for s in range(seeds)]
    return [Setting("lr", LINEAR, Logistic, 2000), *gbm]


@query()
def results_only_models(spark, sf):
    """Linear, boosted (five seeds, averaged in log-odds) and blended result-based models, refitted every season."""
    made = staged(boosting.refits(features(spark, sf), result_settings()))
    lr, bag = made.where("model = 'lr'"), averaged(made.where("model <> 'lr'"), "ro_gbm")
    out = lr.withColumn("model", F.lit("ro_lr")).unionByName(bag).unionByName(blended(bag, lr, 0.75, "ro_best"))
    return out.select("model", "game_id", "season", "home_win", six(F.col("p")).alias("p"))


@query()
def results_only_tuning(spark, sf):
    """Feature sets times boosting grids, chosen on validation seasons."""
    settings = [Setting(f"{s}_{k}", names, lambda d=d, lr=lr, n=n: Boosted(n, d, lr, leaf=40), 2000) for s, names in SETS.items() for k, (d, lr, n) in GRIDS.items()]
    return chosen(boosting.refits(features(spark, sf), settings))


@query()
def blend_tuning(spark, sf):
    """Weights of the boosted model in the blend with the linear one, chosen on validation seasons."""
    made = staged(boosting.refits(features(spark, sf), result_settings(1)))
    parts = [blended(made.where("model = 'gbm0'"), made.where("model = 'lr'"), w, f"w{w}") for w in BLENDS]
    return chosen(reduce(DataFrame.unionByName, parts))


@query()
def rating_sweep(spark, sf):
    """Settings of the ratings themselves: each its own snapshots, features, models and blend, by validation log loss."""
    base = staged(skeleton(spark, sf))
    parts = []
    for name, settings in SWEEP.items():
        models = [Setting("gbm", SETS["orig"], lambda: Boosted(400, 3, 0.04, leaf=40), 2000), Setting("lr", LINEAR, Logistic, 2000)]
        made = staged(boosting.refits(features(spark, sf, settings, base), models))
        parts.append(blended(made.where("model = 'gbm'"), made.where("model = 'lr'"), 0.75, name))
    return chosen(reduce(DataFrame.unionByName, parts))


def plain_features(spark, sf) -> DataFrame:
    return skeleton(spark, sf).withColumn("home_ind", 1 - F.col("neutral"))


def plain_settings() -> list[Setting]:
    return [Setting("gbm", PLAIN, lambda: Boosted(400, 3, 0.05, leaf=40)), Setting("mlp", PLAIN, Perceptron), Setting("lr", PLAIN, Logistic)]


@query()
def season_models(spark, sf):
    """Boosting, perceptron and logistic fits of the ten plain features, refitted every season with 500 earlier games."""
    m = boosting.refits(plain_features(spark, sf), plain_settings())
    return m.select("model", "game_id", "season", "home_win", six(F.col("p")).alias("p"))


def base_models(spark, sf) -> DataFrame:
    """Chances of six base models, long: Elo, ranks, strengths, blades and the two season models."""
    g = timed_games(spark, sf)
    f = staged(plain_features(spark, sf))
    week = walkforward.weekly(g, {"pr_points_keep": walkforward.pagerank_system("points_keep"), "bradley_terry": walkforward.bradley_terry_system(0.65), "blade_chest": walkforward.blade_chest_system()})
    week = with_seasons(week, g).select("model", "game_id", "season", "home_win", "p")
    season = boosting.refits(f, plain_settings()[:2])
    return f.select(F.lit("elo").alias("model"), "game_id", "season", "home_win", F.col("elo_prob").alias("p")).unionByName(week).unionByName(season)


BASE = ("elo", "pr_points_keep", "bradley_terry", "blade_chest", "gbm", "mlp")


def with_seasons(preds: DataFrame, g: DataFrame) -> DataFrame:
    """Predictions by period with their seasons: a period is of one season, so games needn't be joined."""
    return preds.join(F.broadcast(g.select("period", "season").distinct()), "period")  # a row a period


def wide(preds: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Log-odds of ``models``, a column each."""
    return preds.groupBy("game_id", "season", "home_win").pivot("model", list(models)).agg(F.first(logit(F.col("p")))).withColumn("margin", F.lit(0.0))


def spreads(spark, sf) -> DataFrame:
    """Consensus spreads by game. Line items are ranked once: the vote on abbreviations and the medians read what is stored."""
    odds = line_odds(spark, sf).where("market_type = 'spread'")
    return lines.consensus_spreads(stored(odds.select("game_id", "abbr", "home_team", "away_team", "lines", "opening_lines", "market_type")))


def lined(spark, sf) -> DataFrame:
    return games(spark, sf).select("game_id").join(spreads(spark, sf), "game_id", "left")


def calibrated_lines(spark, sf) -> DataFrame:
    """Chances from the closing and opening spread, calibrated every season on all earlier ones."""
    f = walkforward.evaluated(games(spark, sf)).select("game_id", "season", "home_win", "margin").join(spreads(spark, sf), "game_id", "left")
    return boosting.calibrations(f, {"market": ("spread_home", 300), "open": ("open_spread_home", 500)})


@query()
def spread_calibration(spark, sf):
    m = calibrated_lines(spark, sf)
    return m.select("model", "game_id", "season", "home_win", six(F.col("p")).alias("p"))


@query()
def ensemble(spark, sf):
    """Logistic stack of six base models' log-odds by season, and of that with the market; all of them scored."""
    preds = staged(base_models(spark, sf))
    stack = staged(boosting.refits(wide(preds, BASE), [Setting("ensemble", BASE, lambda: Logistic(1.0, scale=False), 800)]))
    market = staged(calibrated_lines(spark, sf).where("model = 'market'"))
    both = boosting.refits(wide(stack.unionByName(market), ("market", "ensemble")), [Setting("market_plus_model", ("market", "ensemble"), lambda: Logistic(1.0, scale=False), 800)])
    return scored(preds.unionByName(stack).unionByName(market).unionByName(both))


@query()
def bucketed_stack(spark, sf):
    """The market and the ranks stacked by band of weeks."""
    g = timed_games(spark, sf)
    ranks = walkforward.weekly(g, {"pr_points_keep": walkforward.pagerank_system("points_keep")}).join(g.select("game_id", "season", "week"), "game_id")
    own = wide(ranks.select("model", "game_id", "season", "home_win", "p").unionByName(calibrated_lines(spark, sf).where("model = 'market'")), ("market", "pr_points_keep"))
    own = own.join(g.select("game_id", "week"), "game_id")
    b = boosting.bucketed(own, ("market", "pr_points_keep"), ((0, 3), (4, 8), (9, 99)))
    return b.select("game_id", "season", "home_win", six(F.col("p")).alias("p"))


@query()
def opening_blend(spark, sf):
    """The weights of the opening line and of a rating model that predict best, season by season."""
    g = timed_games(spark, sf)
    model = with_seasons(walkforward.weekly(g, {"ridge_margin": walkforward.ridge_system()}), g).select("model", "game_id", "season", "home_win", "p")
    own = wide(model.unionByName(calibrated_lines(spark, sf).where("model = 'open'")), ("open", "ridge_margin"))
    w = boosting.weights_by_season(own, ("open", "ridge_margin"))
    return w.select("season", "n", F.round("open", 4).alias("open"), F.round("ridge_margin", 4).alias("ridge_margin"))


@query()
def market_incremental(spark, sf):
    """What a rating model adds to the market: log loss of both and of their stack on the games that have all."""
    g = timed_games(spark, sf)
    model = with_seasons(walkforward.weekly(g, {"ridge_margin": walkforward.ridge_system()}), g).select("model", "game_id", "season", "home_win", "p")
    preds = staged(model.unionByName(calibrated_lines(spark, sf).where("model = 'market'")))
    stack = staged(boosting.refits(wide(preds, ("market", "ridge_margin")), [Setting("market_plus_model", ("market", "ridge_margin"), lambda: Logistic(1.0, scale=False), 800)]))
    return scored(stack.unionByName(preds.join(stack.select("game_id"), "game_id", "left_semi").select(*stack.columns)))
