"""Queries over games, lines and form."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions.scalar import win_probability
from paceline.operators import form, lines
from paceline.plans.oracle import GAMES, ODDS, SIDES, SPREADS
from paceline.plans.registry import query
from paceline.sources.tables import games, line_odds, periods, six, timed_games, upsert


@query(GAMES + " SELECT g.* EXCLUDE (home_pregame_elo, away_pregame_elo), round(home_pregame_elo, 6) AS home_pregame_elo, round(away_pregame_elo, 6) AS away_pregame_elo, period FROM games g JOIN periods USING (season, st_order, week)")
def games_base(spark, sf):
    return timed_games(spark, sf).withColumns({c: F.round(c, 6) for c in ("home_pregame_elo", "away_pregame_elo")})


@query(GAMES + " SELECT p.*, n_games FROM periods p JOIN (SELECT season, st_order, week, count(*) AS n_games FROM games GROUP BY ALL) USING (season, st_order, week)")
def period_calendar(spark, sf):
    g = games(spark, sf).groupBy("season", "st_order", "week").agg(F.count("*").alias("n_games"))
    return periods(g).join(g, ["season", "st_order", "week"])


@query(GAMES + SPREADS + " SELECT * FROM spreads")
def consensus_spread(spark, sf):
    return lines.consensus_spreads(line_odds(spark, sf))


@query(GAMES + SPREADS + " SELECT abbr, team, n FROM voted")
def abbr_majority_vote(spark, sf):
    return lines.abbreviation_votes(line_odds(spark, sf))


@query(GAMES + ODDS + """, m AS (SELECT game_id, side, median(CASE WHEN odds < 0 THEN 1 + 100 / abs(odds) ELSE 1 + odds / 100 END) AS o FROM odds WHERE market_type = 'money_line' GROUP BY ALL)
    SELECT game_id, round(max(CASE WHEN side = 'home' THEN o END), 6) AS home_odds, round(max(CASE WHEN side = 'away' THEN o END), 6) AS away_odds FROM m GROUP BY game_id""")
def moneyline_pivot(spark, sf):
    return lines.moneylines(line_odds(spark, sf)).select("game_id", six(F.col("home_odds")).alias("home_odds"), six(F.col("away_odds")).alias("away_odds"))


@query(GAMES + " SELECT season, count(*) FILTER (home_division = 'fbs' AND away_division = 'fbs') AS both_fbs, count(*) FILTER (home_division = 'fbs' OR away_division = 'fbs') AS one_fbs, count(*) AS n FROM games GROUP BY season")
def fbs_scope(spark, sf):
    h, a = F.col("home_division") == "fbs", F.col("away_division") == "fbs"
    return games(spark, sf).groupBy("season").agg(F.count_if(h & a).alias("both_fbs"), F.count_if(h | a).alias("one_fbs"), F.count("*").alias("n"))


@query(GAMES + " SELECT game_id, home_win FROM games g SEMI JOIN (SELECT game_id FROM games WHERE home_division = 'fbs' AND away_division = 'fbs' AND season BETWEEN 1998 AND 2001) e USING (game_id)")
def eval_semi(spark, sf):
    g = games(spark, sf)
    ids = g.where("home_division = 'fbs' and away_division = 'fbs' and season between 1998 and 2001").select("game_id")
    return g.select("game_id", "home_win").join(ids, "game_id", "left_semi")


@query(GAMES + """, old AS (SELECT season, season_type, count(*) AS n FROM games GROUP BY ALL), fresh AS (SELECT season, season_type, sum(margin)::BIGINT AS n FROM games WHERE season >= 2000 GROUP BY ALL)
    SELECT * FROM old ANTI JOIN fresh USING (season, season_type) UNION ALL SELECT * FROM fresh""")
def replace_anti_union(spark, sf):
    g = games(spark, sf)
    old = g.groupBy("season", "season_type").agg(F.count("*").alias("n"))
    new = g.where("season >= 2000").groupBy("season", "season_type").agg(F.sum("margin").alias("n"))
    return upsert(old, new, ["season", "season_type"])


_FORM = GAMES + SIDES + """,
f AS (SELECT *, count(*) OVER w AS gp, coalesce(avg(win) OVER w, 0.5) AS win_pct, least(greatest(coalesce(avg(margin) OVER w, 0), -28), 28) AS avg_margin,
    least(greatest(coalesce(avg(margin) OVER (PARTITION BY season, team ORDER BY st_order, week, start_date, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), -28), 28) AS last3,
    floor((epoch(start_date) - epoch(lag(start_date) OVER (PARTITION BY season, team ORDER BY st_order, week, start_date, game_id))) / 86400)::BIGINT AS rest
    FROM sides WINDOW w AS (PARTITION BY season, team ORDER BY st_order, week, start_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT h.game_id, h.gp AS home_gp, a.gp AS away_gp, h.win_pct - a.win_pct AS win_pct_diff, h.avg_margin - a.avg_margin AS avg_margin_diff, h.last3 - a.last3 AS last3_diff,
    h.rest AS home_rest, a.rest AS away_rest FROM f h JOIN f a ON h.game_id = a.game_id AND h.side = 'home' AND a.side = 'away')"""


@query(_FORM + " SELECT game_id, home_gp, away_gp, round(win_pct_diff, 6) AS win_pct_diff, round(avg_margin_diff, 6) AS avg_margin_diff FROM p")
def form_v1(spark, sf):
    f = form.game_form(games(spark, sf))
    return f.select("game_id", "home_gp", "away_gp", six(F.col("win_pct_diff")).alias("win_pct_diff"), six(F.col("avg_margin_diff")).alias("avg_margin_diff"))


@query(_FORM + " SELECT game_id, least(home_gp, away_gp) AS gp_min, home_gp - away_gp AS gp_diff, round(win_pct_diff, 6) AS win_pct_diff, round(avg_margin_diff, 6) AS avg_margin_diff, round(last3_diff, 6) AS last3_diff, coalesce(home_rest - away_rest, 0) AS rest_diff FROM p JOIN games USING (game_id) WHERE home_division = 'fbs' OR away_division = 'fbs'")
def form_v2(spark, sf):
    g = games(spark, sf)
    f = form.game_form(g).join(g.where("home_division = 'fbs' or away_division = 'fbs'").select("game_id"), "game_id", "left_semi")
    return f.select("game_id", "gp_min", "gp_diff", *[six(F.col(c)).alias(c) for c in ("win_pct_diff", "avg_margin_diff", "last3_diff")], "rest_diff")


@query(_FORM + " SELECT game_id, home_rest, away_rest, coalesce(home_rest - away_rest, 0) AS rest_diff FROM p")
def rest_days(spark, sf):
    return form.game_form(games(spark, sf)).select("game_id", "home_rest", "away_rest", "rest_diff")


@query(GAMES + """, t AS (SELECT *, CASE WHEN home_team <= away_team THEN 1 ELSE -1 END AS turned FROM games)
    SELECT game_id, count(*) OVER w AS h2h_n, round(coalesce(avg(margin * turned) OVER w, 0) * turned, 6) + 0.0 AS h2h_margin FROM t
    WINDOW w AS (PARTITION BY least(home_team, away_team), greatest(home_team, away_team) ORDER BY season, st_order, week, start_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def head_to_head(spark, sf):
    return form.head_to_head(games(spark, sf)).select("game_id", "h2h_n", six(F.col("h2h_margin")).alias("h2h_margin"))


@query(GAMES + " SELECT game_id, round(1 / (1 + pow(10, -(home_pregame_elo - away_pregame_elo + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 400)), 6) AS p FROM games WHERE home_pregame_elo IS NOT NULL AND away_pregame_elo IS NOT NULL")
def pregame_elo_prob(spark, sf):
    g = games(spark, sf).na.drop(subset=["home_pregame_elo", "away_pregame_elo"])
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    return g.select("game_id", six(win_probability(edge)).alias("p"))


@query(GAMES + " SELECT team FROM (SELECT home_team AS team FROM games UNION SELECT away_team FROM games)")
def team_names(spark, sf):
    g = games(spark, sf)
    return g.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
