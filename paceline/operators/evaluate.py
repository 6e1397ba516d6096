"""Forecast evaluation: metrics over slices, calibration, lines beaten, disagreement, betting rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.scalar import calibration_bin, log_loss

#: Overlapping eras of the derived games.
ERAS = (("1995-2001", 1995, 2001), ("1998-2001", 1998, 2001), ("2000-2001", 2000, 2001))
#: Fixed values of the betting grid: first weeks, spreads, edges.
GRID_WEEKS, GRID_SPREADS, GRID_EDGES = (1, 5, 8, 10), (3.0, 7.0, 99.0), (0.0, 0.03, 0.05, 0.08)
BREAK_EVEN = 110 / 210


def metrics(preds: DataFrame, *by: str, least: int = 0) -> DataFrame:
    """n, accuracy, log loss and Brier score of the predictions that there are, by slice and model."""
    y, p = F.col("home_win"), F.col("p")
    hit = ((p >= 0.5).cast("int") == y).cast("double")
    some = p.isNotNull()
    out = preds.groupBy(*by, "model").agg(F.count("p").alias("n"), F.avg(F.when(some, hit)).alias("acc"), F.avg(log_loss(p, y)).alias("logloss"), F.avg(F.pow(p - y, 2)).alias("brier"))
    return out.where(F.col("n") >= least) if least else out


def with_eras(df: DataFrame, eras=ERAS) -> DataFrame:
    """A row for each era that its season is in; eras overlap."""
    inside = F.array_compact(F.array(*[F.when(F.col("season").between(a, z), F.lit(name)) for name, a, z in eras]))
    return df.withColumn("era", F.explode(inside))


def calibration(preds: DataFrame) -> DataFrame:
    rows = preds.where("p is not null").withColumn("bin", calibration_bin(F.col("p")))
    return rows.groupBy("model", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("pred_mean"), F.avg("home_win").alias("obs_rate"))


def graded(preds: DataFrame, line: str = "spread_home") -> DataFrame:
    """Picks against the line: home where the model is above the market; pushes are dropped."""
    market = 1 / (1 + F.exp(F.col(line) / 7.0))
    rows = preds.where(F.col(line).isNotNull() & F.col("p").isNotNull()).withColumn("market_p", market)
    cover = F.col("margin") + F.col(line)
    rows = rows.where(cover != 0).withColumn("pick_home", F.col("p") > F.col("market_p"))
    return rows.withColumn("won", (F.col("pick_home") == (cover > 0)).cast("int"))


def betting_grid(spark: SparkSession) -> DataFrame:
    """96 rules, made of ranges: rows of a fixed number."""
    one = lambda name, values: F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
    g = spark.range(1).select(one("w_min", GRID_WEEKS))
    for name, values in (("s_max", GRID_SPREADS), ("e_min", GRID_EDGES), ("market", ("ML", "ATS"))):
        g = g.select("*", one(name, values))
    return g


def bets(lined_preds: DataFrame, odds: DataFrame) -> DataFrame:
    """What a stake of 100 would have made on each game by either market: the rule's inputs and profits."""
    rows = lined_preds.where("open_spread_home is not null and p is not null").join(odds, "game_id", "left")
    market = 1 / (1 + F.exp(F.col("open_spread_home") / 7.0))
    rows = rows.withColumns({"edge": F.abs(F.col("p") - market), "pick_home": F.col("p") > market})
    price = F.when(F.col("pick_home"), F.col("home_odds")).otherwise(F.col("away_odds"))
    won_ml = F.col("pick_home") == (F.col("home_win") == 1)
    cover = F.col("margin") + F.col("spread_home")
    ml = F.when(price.isNotNull(), F.when(won_ml, 100 * (price - 1)).otherwise(-100.0))
    ats = F.when(cover.isNotNull(), F.when(cover == 0, 0.0).when(F.col("pick_home") == (cover > 0), 100 / 1.1).otherwise(-100.0))
    return rows.withColumns({"profit_ML": ml, "profit_ATS": ats})


def rule_results(placed: DataFrame, split: int) -> DataFrame:
    """All 96 rules over all bets in one pass: bets are summed by cell first, and rules are sums of cells.

    Train: seasons up to ``split``; test: later ones. No rule is joined with the bets.
    """
    # Cells (first week, spread, edge bands) are far fewer than bets; a rule is a sum over cells.
    band = lambda c, edges: reduce(lambda out, k: F.when(c >= k[1], k[0]).otherwise(out), enumerate(edges), F.lit(-1))
    rows = placed.withColumns({"wb": band(F.col("week"), GRID_WEEKS), "sb": F.when(F.abs("open_spread_home") <= 3, 0).when(F.abs("open_spread_home") <= 7, 1).when(F.abs("open_spread_home") <= 99, 2).otherwise(3), "eb": band(F.col("edge"), GRID_EDGES), "train": F.col("season") <= split})
    market = F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.col(f"profit_{m}").alias("profit")) for m in ("ML", "ATS")])).alias("b")
    rows = rows.select("wb", "sb", "eb", "train", market).select("wb", "sb", "eb", "train", "b.*").where("profit is not null")
    cells = rows.groupBy("wb", "sb", "eb", "train", "market").agg(F.count("*").alias("n"), F.sum("profit").alias("total"), F.sum((F.col("profit") > 0).cast("int")).alias("wins"))
    grid = betting_grid(placed.sparkSession)
    at = lambda c, values: reduce(lambda out, k: F.when(c == k[1], k[0]).otherwise(out), enumerate(values), F.lit(-1))
    grid = grid.withColumns({"gw": at(F.col("w_min"), GRID_WEEKS), "gs": at(F.col("s_max"), GRID_SPREADS), "ge": at(F.col("e_min"), GRID_EDGES)}).withColumnRenamed("market", "m")
    hit = (F.col("wb") >= F.col("gw")) & (F.col("sb") <= F.col("gs")) & (F.col("eb") >= F.col("ge")) & (F.col("market") == F.col("m"))
    joined = F.broadcast(grid).join(cells, hit, "left")  # 96 rows
    part = lambda c, t: F.coalesce(F.sum(F.when(F.col("train") == t, F.col(c))), F.lit(0))
    out = joined.groupBy("w_min", "s_max", "e_min", F.col("m").alias("market")).agg(
        part("n", True).alias("tr_n"), part("total", True).alias("tr_profit"), part("n", False).alias("te_n"), part("total", False).alias("te_profit"), part("wins", False).alias("te_wins")
    )
    rate = lambda a, n: F.when(F.col(n) > 0, F.col(a) / (F.col(n) * 100))
    return out.withColumns({"tr_roi": rate("tr_profit", "tr_n"), "te_roi": rate("te_profit", "te_n")})


def share(cond: Column) -> Column:
    """Mean of a condition, a null one counting as false."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
