"""Betting lines: the vote on whom an abbreviation means, consensus spreads, odds side by side, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import decimal_odds, sigmoid, win_probability

#: Points of spread that change the odds of winning by a factor of e.
SPREAD_SCALE = 7.0


def abbreviation_votes(odds: DataFrame) -> DataFrame:
    """Which team an abbreviation means: games it occurs in vote once for both teams; ties go to the first name."""
    pairs = odds.where("market_type = 'spread'").select("game_id", "abbr", "home_team", "away_team").distinct()
    votes = pairs.select("abbr", F.explode(F.array("home_team", "away_team")).alias("team")).groupBy("abbr", "team").agg(F.count("*").alias("n"))
    best = Window.partitionBy("abbr").orderBy(F.desc("n"), "team")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("abbr", "team", "n")


def consensus_spreads(odds: DataFrame) -> DataFrame:
    """Median closing and opening spread of each game, home side's view: negative favours the home side."""
    rows = odds.where("market_type = 'spread'").join(abbreviation_votes(odds).drop("n"), "abbr").where("team = home_team")
    return rows.groupBy("game_id").agg(F.round(F.median("lines"), 6).alias("spread_home"), F.round(F.median("opening_lines"), 6).alias("open_spread_home"))


def moneylines(odds: DataFrame) -> DataFrame:
    """Median decimal odds of a game's sides, as two columns."""
    rows = odds.where("market_type = 'money_line'").withColumn("decimal", decimal_odds(F.col("odds")))
    wide = rows.groupBy("game_id").pivot("side", ["home", "away"]).agg(F.median("decimal"))
    return wide.select("game_id", F.col("home").alias("home_odds"), F.col("away").alias("away_odds"))


def lined_games(g: DataFrame, odds: DataFrame) -> DataFrame:
    return g.join(consensus_spreads(odds), "game_id", "left")


def closed_form_predictions(lined: DataFrame) -> DataFrame:
    """Long predictions by closed forms: pre-season ratings, closing line, opening line; null where there is no input."""
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    made = [("prior", win_probability(edge)), ("market", sigmoid(-F.col("spread_home") / SPREAD_SCALE)), ("opening", sigmoid(-F.col("open_spread_home") / SPREAD_SCALE))]
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), p.alias("p")) for m, p in made])).alias("q")
    return lined.select("*", one).select("*", "q.*").drop("q")
