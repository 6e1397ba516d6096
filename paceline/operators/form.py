"""Season-to-date form of teams, by windows over a game's two sides; only earlier games count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import clipped, whole_days

CAP = 28.0
ORDER = ("st_order", "week", "start_date", "game_id")


def sides(g: DataFrame) -> DataFrame:
    """A game as two rows: one pass over the games, no union of two scans."""
    common = ("game_id", "season", "st_order", "week", "start_date")
    side = lambda s, t, o, win, m: F.struct(F.lit(s).alias("side"), F.col(t).alias("team"), F.col(o).alias("opp"), win.alias("win"), m.alias("margin"))
    both = F.array(side("home", "home_team", "away_team", F.col("home_win"), F.col("margin")), side("away", "away_team", "home_team", 1 - F.col("home_win"), -F.col("margin")))
    return g.select(*common, F.explode(both).alias("s")).select(*common, "s.*")


def side_form(g: DataFrame) -> DataFrame:
    """Per game and side: games played, win share, mean margin, mean of the last three, whole days of rest."""
    w = Window.partitionBy("season", "team").orderBy(*ORDER)
    past, three = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(-3, -1)
    return sides(g).select(
        "game_id", "side", "team", "season", "week", F.count("*").over(past).alias("gp"), F.coalesce(F.avg("win").over(past), F.lit(0.5)).alias("win_pct"),
        F.coalesce(clipped(F.avg("margin").over(past), -CAP, CAP), F.lit(0.0)).alias("avg_margin"), F.coalesce(clipped(F.avg("margin").over(three), -CAP, CAP), F.lit(0.0)).alias("last3"),
        whole_days(F.col("start_date"), F.last("start_date", ignorenulls=True).over(past)).alias("rest"),
    )


def game_form(g: DataFrame) -> DataFrame:
    """Home-minus-away form of each game."""
    f = side_form(g).groupBy("game_id")
    names = ("gp", "win_pct", "avg_margin", "last3", "rest")
    wide = f.agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("home", "away") for c in names])
    d = lambda c: F.col(f"home_{c}") - F.col(f"away_{c}")
    return wide.withColumns({"win_pct_diff": d("win_pct"), "avg_margin_diff": d("avg_margin"), "last3_diff": d("last3"), "rest_diff": F.coalesce(d("rest"), F.lit(0)), "gp_min": F.least("home_gp", "away_gp"), "gp_diff": d("gp")})


def head_to_head(g: DataFrame, last: int = 5) -> DataFrame:
    """Mean margin of the last meetings of two teams before a game, seen from its home side, and their number."""
    turned = F.when(F.col("home_team") <= F.col("away_team"), 1).otherwise(-1)
    rows = g.withColumns({"lo": F.least("home_team", "away_team"), "hi": F.greatest("home_team", "away_team"), "turned": turned}).withColumn("m", F.col("margin") * F.col("turned"))
    w = Window.partitionBy("lo", "hi").orderBy("season", *ORDER).rowsBetween(-last, -1)
    return rows.select("game_id", F.count("*").over(w).alias("h2h_n"), (F.coalesce(F.avg("m").over(w), F.lit(0.0)) * F.col("turned")).alias("h2h_margin"))
