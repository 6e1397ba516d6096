"""Queries that score forecasts and bets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions import scalar
from paceline.operators import evaluate, lines
from paceline.operators.quantiles import quantiles
from paceline.plans.oracle import GAMES, PREDICTIONS
from paceline.plans.registry import query
from paceline.sources import tables
from paceline.sources.tables import games, line_odds, six, staged

P = GAMES + PREDICTIONS
_METRICS = """count(p) AS n, round(avg(CASE WHEN p IS NOT NULL THEN ((p >= 0.5)::INT = home_win)::INT END), 6) AS acc,
    round(avg(-(home_win * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - home_win) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) FILTER (p IS NOT NULL), 6) AS logloss, round(avg(pow(p - home_win, 2)), 6) AS brier"""
_ERAS = ", eras AS (SELECT * FROM (VALUES ('1995-2001', 1995, 2001), ('1998-2001', 1998, 2001), ('2000-2001', 2000, 2001)) e(era, a, z))"
_GRADED = ", graded AS (SELECT *, 1 / (1 + exp(spread_home / 7)) AS market_p, ((p > 1 / (1 + exp(spread_home / 7))) = (margin + spread_home > 0))::INT AS won FROM predictions WHERE p IS NOT NULL AND spread_home IS NOT NULL AND margin + spread_home <> 0)"


def predictions(spark, sf) -> DataFrame:
    return lines.closed_form_predictions(lines.lined_games(games(spark, sf), line_odds(spark, sf)))


def prior_predictions(spark, sf) -> DataFrame:
    """Pre-season ratings only: games alone, without lines."""
    g = games(spark, sf)
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    return g.withColumns({"model": F.lit("prior"), "p": scalar.win_probability(edge)})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in names})


@query(P + f" SELECT season, model, {_METRICS} FROM predictions GROUP BY season, model")
def metrics_by_season(spark, sf):
    return rounded(evaluate.metrics(predictions(spark, sf), "season"), "acc", "logloss", "brier")


@query(P + f" SELECT week, model, {_METRICS} FROM predictions WHERE season_type = 'regular' GROUP BY week, model HAVING count(p) >= 30")
def metrics_by_week(spark, sf):
    return rounded(evaluate.metrics(predictions(spark, sf).where("season_type = 'regular'"), "week", least=30), "acc", "logloss", "brier")


@query(P + _ERAS + f" SELECT era, model, {_METRICS} FROM predictions JOIN eras ON season BETWEEN a AND z GROUP BY era, model")
def metrics_by_era(spark, sf):
    return rounded(evaluate.metrics(evaluate.with_eras(predictions(spark, sf)), "era"), "acc", "logloss", "brier")


@query(P + " SELECT model, (CASE WHEN p < 0.1 THEN 0 WHEN p < 0.2 THEN 1 WHEN p < 0.3 THEN 2 WHEN p < 0.4 THEN 3 WHEN p < 0.5 THEN 4 WHEN p < 0.6 THEN 5 WHEN p < 0.7 THEN 6 WHEN p < 0.8 THEN 7 WHEN p < 0.9 THEN 8 ELSE 9 END)::INT AS bin, count(*) AS n, round(avg(p), 6) AS pred_mean, round(avg(home_win), 6) AS obs_rate FROM predictions WHERE p IS NOT NULL GROUP BY 1, 2")
def calibration_table(spark, sf):
    return rounded(evaluate.calibration(predictions(spark, sf)), "pred_mean", "obs_rate")


@query(P + _ERAS + _GRADED + " SELECT era, model, count(*) AS n, round(100 * avg(won), 6) AS ats_win_pct, round(11000 / 210.0, 6)::DOUBLE AS break_even FROM graded JOIN eras ON season BETWEEN a AND z GROUP BY era, model")
def ats(spark, sf):
    g = evaluate.with_eras(evaluate.graded(predictions(spark, sf)))
    out = g.groupBy("era", "model").agg(F.count("*").alias("n"), six(100 * F.avg("won")).alias("ats_win_pct"))
    return out.withColumn("break_even", F.lit(round(100 * evaluate.BREAK_EVEN, 6)))


@query(P + " SELECT model, count(*) AS n, round(avg(((p >= 0.5) <> (1 / (1 + exp(spread_home / 7)) >= 0.5))::INT), 6) AS disagree, round(avg(CASE WHEN (p >= 0.5) <> (1 / (1 + exp(spread_home / 7)) >= 0.5) THEN ((p >= 0.5)::INT = home_win)::INT END), 6) AS model_right FROM predictions WHERE p IS NOT NULL AND spread_home IS NOT NULL GROUP BY model")
def disagreement(spark, sf):
    rows = predictions(spark, sf).where("p is not null and spread_home is not null").withColumn("apart", (F.col("p") >= 0.5) != (1 / (1 + F.exp(F.col("spread_home") / 7)) >= 0.5))
    right = F.when(F.col("apart"), ((F.col("p") >= 0.5).cast("int") == F.col("home_win")).cast("int"))
    return rows.groupBy("model").agg(F.count("*").alias("n"), six(F.avg(F.col("apart").cast("int"))).alias("disagree"), six(F.avg(right)).alias("model_right"))


_PROFILE = P + """, d AS (SELECT *, 1 / (1 + exp(spread_home / 7)) AS mp FROM predictions WHERE model = 'prior' AND p IS NOT NULL AND spread_home IS NOT NULL),
b AS (SELECT *, CASE WHEN ((p >= 0.5)::INT = home_win) AND ((mp >= 0.5)::INT <> home_win) THEN 'MODEL_WINS' WHEN ((p >= 0.5)::INT <> home_win) AND ((mp >= 0.5)::INT = home_win) THEN 'VEGAS_WINS' ELSE 'OTHER' END AS bucket FROM d)"""


@query(_PROFILE + " SELECT bucket, metric, round(value, 6) AS value FROM (SELECT bucket, count(*)::DOUBLE AS n, avg(abs(spread_home)) AS abs_spread, avg(abs(p - mp)) AS gap, avg(week)::DOUBLE AS mean_week, avg(neutral_site::INT)::DOUBLE AS neutral, avg(conference_game::INT)::DOUBLE AS conference, avg(abs(margin))::DOUBLE AS abs_margin, avg(home_win)::DOUBLE AS home_wins FROM b GROUP BY bucket) UNPIVOT (value FOR metric IN (n, abs_spread, gap, mean_week, neutral, conference, abs_margin, home_wins))")
def bucket_profile(spark, sf):
    rows = predictions(spark, sf).where("model = 'prior' and p is not null and spread_home is not null").withColumn("mp", 1 / (1 + F.exp(F.col("spread_home") / 7)))
    model, market = ((F.col(c) >= 0.5).cast("int") == F.col("home_win") for c in ("p", "mp"))
    rows = rows.withColumn("bucket", F.when(model & ~market, "MODEL_WINS").when(~model & market, "VEGAS_WINS").otherwise("OTHER"))
    made = {"n": F.count("*").cast("double"), "abs_spread": F.avg(F.abs("spread_home")), "gap": F.avg(F.abs(F.col("p") - F.col("mp"))), "mean_week": F.avg("week"), "neutral": F.avg(F.col("neutral_site").cast("int")), "conference": F.avg(F.col("conference_game").cast("int")), "abs_margin": F.avg(F.abs("margin")), "home_wins": F.avg("home_win")}
    wide = rows.groupBy("bucket").agg(*[v.alias(k) for k, v in made.items()])
    return rounded(wide.unpivot(["bucket"], list(made), "metric", "value"), "value")


@query(P + " SELECT band, home_away, count(*) AS n, round(avg(home_win), 6) AS win_rate FROM (SELECT CASE WHEN abs(spread_home) > 0 AND abs(spread_home) <= 3 THEN '(0,3]' WHEN abs(spread_home) > 3 AND abs(spread_home) <= 7 THEN '(3,7]' WHEN abs(spread_home) > 7 THEN '(7,inf]' END AS band, CASE WHEN spread_home < 0 THEN 'home' ELSE 'road' END AS home_away, home_win FROM lined WHERE spread_home IS NOT NULL) WHERE band IS NOT NULL GROUP BY ALL")
def winrate_bins(spark, sf):
    rows = lines.lined_games(games(spark, sf), line_odds(spark, sf)).where("spread_home is not null")
    rows = rows.withColumns({"band": scalar.right_closed(F.abs("spread_home"), (0.0, 3.0, 7.0, float("inf"))), "home_away": F.when(F.col("spread_home") < 0, "home").otherwise("road")}).where("band is not null")
    return rows.groupBy("band", "home_away").agg(F.count("*").alias("n"), six(F.avg("home_win")).alias("win_rate"))


@query(P + ", bands AS (SELECT * FROM (VALUES ('<=3', 0, 3), ('3-10', 3, 10), ('>=10', 10, 999)) b(band, lo, hi)) SELECT band, model, count(*) AS n, round(avg(pow(p - home_win, 2)), 6) AS brier FROM predictions JOIN bands ON abs(open_spread_home) BETWEEN lo AND hi WHERE p IS NOT NULL GROUP BY ALL")
def overlap_slices(spark, sf):
    x = F.abs("open_spread_home")
    inside = F.array_compact(F.array(F.when(x <= 3, "<=3"), F.when(x.between(3, 10), "3-10"), F.when(x.between(10, 999), ">=10")))
    rows = predictions(spark, sf).where("p is not null and open_spread_home is not null").withColumn("band", F.explode(inside))
    return rows.groupBy("band", "model").agg(F.count("*").alias("n"), six(F.avg(F.pow(F.col("p") - F.col("home_win"), 2))).alias("brier"))


@query(P + " SELECT season, count(*) AS n, round(avg((sign(spread_home - open_spread_home) = sign(open_p - p))::INT), 6) AS agree FROM (SELECT *, 1 / (1 + exp(open_spread_home / 7)) AS open_p FROM predictions WHERE model = 'prior') WHERE p IS NOT NULL AND spread_home IS NOT NULL AND open_spread_home IS NOT NULL AND spread_home <> open_spread_home GROUP BY season")
def line_move(spark, sf):
    rows = predictions(spark, sf).where("model = 'prior' and p is not null and spread_home <> open_spread_home")
    move, gap = F.signum(F.col("spread_home") - F.col("open_spread_home")), F.signum(1 / (1 + F.exp(F.col("open_spread_home") / 7)) - F.col("p"))
    return rows.groupBy("season").agg(F.count("*").alias("n"), six(F.avg((move == gap).cast("int"))).alias("agree"))


@query(P + ", q AS (SELECT *, abs(p - 1 / (1 + exp(open_spread_home / 7))) AS gap, ((p > 1 / (1 + exp(open_spread_home / 7))) = (margin + open_spread_home > 0))::INT AS won FROM predictions WHERE model = 'prior' AND p IS NOT NULL AND open_spread_home IS NOT NULL AND margin + open_spread_home <> 0), t AS (SELECT unnest([0.0, 0.5, 0.75, 0.9]) AS quantile, unnest(quantile_cont(gap, [0.0, 0.5, 0.75, 0.9])) AS edge FROM q) SELECT quantile::DOUBLE AS quantile, count(*) AS n, round(100 * avg(won), 6) AS ats_pct FROM q JOIN t ON gap >= edge GROUP BY 1")
def ats_quantile(spark, sf):
    rows = predictions(spark, sf).where("model = 'prior' and p is not null and open_spread_home is not null and margin + open_spread_home <> 0")
    op = 1 / (1 + F.exp(F.col("open_spread_home") / 7))
    rows = rows.select(F.abs(F.col("p") - op).alias("gap"), ((F.col("p") > op) == (F.col("margin") + F.col("open_spread_home") > 0)).cast("int").alias("won"))
    qs = (0.0, 0.5, 0.75, 0.9)
    rows = staged(rows)
    cut = spark.createDataFrame(list(zip(qs, quantiles(rows, "gap", qs))), "quantile double, edge double")
    joined = rows.join(F.broadcast(cut), F.col("gap") >= F.col("edge"))  # four rows
    return joined.groupBy("quantile").agg(F.count("*").alias("n"), six(100 * F.avg("won")).alias("ats_pct"))


_LL = "-(home_win * ln(least(greatest({0}, 1e-12), 1 - 1e-12)) + (1 - home_win) * ln(1 - least(greatest({0}, 1e-12), 1 - 1e-12)))"


@query(P + f", w AS (SELECT game_id, season, home_win, max(CASE WHEN model = 'prior' THEN p END) AS a, max(CASE WHEN model = 'opening' THEN p END) AS b FROM predictions GROUP BY ALL) SELECT season, count(*) AS n, round(avg({_LL.format('a')} - {_LL.format('b')}), 6) AS gap FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY season")
def per_row_logloss_gap(spark, sf):
    rows = lines.lined_games(games(spark, sf), line_odds(spark, sf))
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    rows = rows.withColumns({"a": scalar.win_probability(edge), "b": scalar.sigmoid(-F.col("open_spread_home") / 7)}).where("a is not null and b is not null")
    gap = scalar.log_loss(F.col("a"), F.col("home_win")) - scalar.log_loss(F.col("b"), F.col("home_win"))
    return rows.groupBy("season").agg(F.count("*").alias("n"), six(F.avg(gap)).alias("gap"))


@query(P + " SELECT game_id, round(1 / (1 + exp(-(0.75 * ln(q / (1 - q)) + 0.25 * ln(r / (1 - r))))), 6) AS p FROM (SELECT game_id, least(greatest(1 / (1 + pow(10, -(home_pregame_elo - away_pregame_elo + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 400)), 1e-6), 1 - 1e-6) AS q, least(greatest(1 / (1 + exp(spread_home / 7)), 1e-6), 1 - 1e-6) AS r FROM lined WHERE home_pregame_elo IS NOT NULL AND away_pregame_elo IS NOT NULL AND spread_home IS NOT NULL)")
def logit_blend(spark, sf):
    rows = lines.lined_games(games(spark, sf), line_odds(spark, sf))
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    z = 0.75 * scalar.logit(scalar.win_probability(edge)) + 0.25 * scalar.logit(scalar.sigmoid(-F.col("spread_home") / 7))
    return rows.select("game_id", six(scalar.sigmoid(z)).alias("p")).where("p is not null")


@query(P + " SELECT game_id, model, round(p, 6) AS p FROM predictions WHERE model = 'prior' AND p IS NOT NULL ORDER BY greatest(p, 1 - p) DESC, game_id LIMIT 12")
def top_examples(spark, sf):
    rows = prior_predictions(spark, sf).where("p is not null")
    return rows.orderBy(F.desc(F.greatest("p", 1 - F.col("p"))), "game_id").limit(12).select("game_id", "model", six(F.col("p")).alias("p"))


_BETS = P + """, m AS (SELECT game_id, side, median(CASE WHEN odds < 0 THEN 1 + 100 / abs(odds) ELSE 1 + odds / 100 END) AS o FROM odds WHERE market_type = 'money_line' GROUP BY ALL),
ml AS (SELECT game_id, max(CASE WHEN side = 'home' THEN o END) AS home_odds, max(CASE WHEN side = 'away' THEN o END) AS away_odds FROM m GROUP BY game_id),
e AS (SELECT q.*, home_odds, away_odds, 1 / (1 + exp(open_spread_home / 7)) AS op FROM predictions q LEFT JOIN ml USING (game_id) WHERE model = 'prior' AND p IS NOT NULL AND open_spread_home IS NOT NULL),
placed AS (SELECT *, abs(p - op) AS edge, p > op AS pick_home,
    CASE WHEN (CASE WHEN p > op THEN home_odds ELSE away_odds END) IS NOT NULL THEN CASE WHEN (p > op) = (home_win = 1) THEN 100 * ((CASE WHEN p > op THEN home_odds ELSE away_odds END) - 1) ELSE -100.0 END END AS profit_ml,
    CASE WHEN margin + spread_home IS NOT NULL THEN CASE WHEN margin + spread_home = 0 THEN 0.0 WHEN (p > op) = (margin + spread_home > 0) THEN 100 / 1.1 ELSE -100.0 END END AS profit_ats FROM e),
long AS (SELECT game_id, season, week, open_spread_home, edge, 'ML' AS market, profit_ml AS profit FROM placed WHERE profit_ml IS NOT NULL UNION ALL SELECT game_id, season, week, open_spread_home, edge, 'ATS', profit_ats FROM placed WHERE profit_ats IS NOT NULL),
rules AS (SELECT w_min, s_max, e_min, k.market FROM (SELECT unnest([1, 5, 8, 10])::INT AS w_min), (SELECT unnest([3.0, 7.0, 99.0])::DOUBLE AS s_max), (SELECT unnest([0.0, 0.03, 0.05, 0.08])::DOUBLE AS e_min), (SELECT unnest(['ML', 'ATS']) AS market) k),
grid AS (SELECT r.*, count(profit) FILTER (season <= 1998) AS tr_n, coalesce(sum(profit) FILTER (season <= 1998), 0) AS tr_profit, count(profit) FILTER (season > 1998) AS te_n, coalesce(sum(profit) FILTER (season > 1998), 0) AS te_profit, count(*) FILTER (season > 1998 AND profit > 0) AS te_wins
    FROM rules r LEFT JOIN long l ON l.market = r.market AND week >= w_min AND abs(open_spread_home) <= s_max AND edge >= e_min GROUP BY ALL)"""


def placed_bets(spark, sf) -> DataFrame:
    odds = line_odds(spark, sf)
    return evaluate.bets(predictions(spark, sf).where("model = 'prior'"), lines.moneylines(odds))


@query(_BETS + " SELECT w_min, s_max, e_min, market, tr_n, round(tr_profit / (tr_n * 100), 5) AS tr_roi, te_n, te_wins, round(te_profit, 4) AS te_profit, round(te_profit / (te_n * 100), 5) AS te_roi FROM (SELECT w_min, s_max, e_min, market, nullif(tr_n, 0) AS tr_n, tr_profit, nullif(te_n, 0) AS te_n, te_profit, te_wins FROM grid)")
def betting_grid(spark, sf):
    g = evaluate.rule_results(placed_bets(spark, sf), 1998)
    n = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    return g.select("w_min", "s_max", "e_min", "market", n("tr_n"), (F.round("tr_roi", 5) + 0.0).alias("tr_roi"), n("te_n"), "te_wins", (F.round("te_profit", 4) + 0.0).alias("te_profit"), (F.round("te_roi", 5) + 0.0).alias("te_roi"))


@query(_BETS + " SELECT market, w_min, s_max, e_min, tr_n FROM (SELECT *, row_number() OVER (PARTITION BY market ORDER BY round(tr_profit / (tr_n * 100), 9) DESC, w_min, s_max, e_min) AS r FROM grid WHERE tr_n >= 40) WHERE r = 1")
def best_rule_per_market(spark, sf):
    g = evaluate.rule_results(placed_bets(spark, sf), 1998).where("tr_n >= 40")
    best = Window.partitionBy("market").orderBy(F.desc(F.round("tr_roi", 9)), "w_min", "s_max", "e_min")
    return g.withColumn("r", F.row_number().over(best)).where("r = 1").select("market", "w_min", "s_max", "e_min", "tr_n")


@query(_BETS + " SELECT market, count(*) AS n, round(avg((profit > 0)::INT), 6) AS win, round(sum(profit), 4) AS profit, round(sum(profit) / (100 * count(*)), 6) AS roi, round(avg(profit) / (stddev_samp(profit) / sqrt(count(*))), 6) AS t FROM long WHERE week >= 5 AND abs(open_spread_home) <= 7 AND edge >= 0.05 GROUP BY market")
def betting_rule(spark, sf):
    rows = placed_bets(spark, sf).where("week >= 5 and abs(open_spread_home) <= 7 and edge >= 0.05")
    rows = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("market"), F.col(f"profit_{m}").alias("profit")) for m in ("ML", "ATS")])).alias("b")).select("b.*").where("profit is not null")
    t = F.try_divide(F.avg("profit"), F.stddev_samp("profit") / F.sqrt(F.count("*")))
    return rows.groupBy("market").agg(F.count("*").alias("n"), six(F.avg((F.col("profit") > 0).cast("int"))).alias("win"), (F.round(F.sum("profit"), 4) + 0.0).alias("profit"), six(F.sum("profit") / (100 * F.count("*"))).alias("roi"), six(t).alias("t"))


@query(_BETS + " SELECT game_id, season, week, round(sum(profit) OVER (ORDER BY season, week, game_id ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS bankroll FROM long WHERE market = 'ATS' AND edge >= 0.05")
def bankroll_curve(spark, sf):
    """Running sums in two levels: of weeks over the seasons, and of bets within their week."""
    rows = placed_bets(spark, sf).where("edge >= 0.05 and profit_ATS is not null").select("game_id", "season", "week", F.col("profit_ATS").alias("profit"))
    weeks = rows.groupBy("season", "week").agg(F.sum("profit").alias("profit"))
    before = Window.orderBy("season", "week").rowsBetween(Window.unboundedPreceding, -1)
    base = weeks.select("season", "week", F.coalesce(F.sum("profit").over(before), F.lit(0.0)).alias("base"))  # a row a week
    inside = Window.partitionBy("season", "week").orderBy("game_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("run", F.sum("profit").over(inside)).join(base, ["season", "week"])
    return out.select("game_id", "season", "week", (F.round(F.col("base") + F.col("run"), 4) + 0.0).alias("bankroll"))


#: How far public data can model a category, 0 to 3; 1 for others.
MODELABLE = {"PROMO": 3, "ECONOMY": 3, "STANDARD": 2, "MEDIUM": 2, "SMALL": 1, "LARGE": 0}
#: Markets that end later enter the calibration.
CUT = "1998-01-01 00:00:00"
_MARKETS = """WITH ends AS (SELECT l_partkey, median(l_extendedprice) AS liquidity, max(l_shipdate) AS ends FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey AS market_id, p_type AS category, CASE WHEN p_partkey % 13 <> 0 THEN p_size / 50 END AS price, (p_partkey % 3 <> 0)::INT AS active, liquidity, CASE WHEN p_partkey % 11 <> 0 THEN ends END AS ends,
    CASE WHEN p_retailprice > 960 THEN 1 WHEN p_retailprice > 920 THEN 0 END AS y FROM part LEFT JOIN ends ON l_partkey = p_partkey)"""


def settled(spark, sf) -> DataFrame:
    """Markets with their text read: price, liquidity and end where they are any, y the settlement."""
    m = tables.markets(spark, sf)
    return m.withColumns({"price": tables.numeric(F.col("last_trade_price")), "liquidity": tables.numeric(F.col("liquidity")), "ends": tables.instant(F.col("end_date")), "y": scalar.first_price(F.col("outcome_prices"))})


@query(_MARKETS + " SELECT market_id, category, round(price, 6) AS price, active, round(liquidity, 4) AS liquidity, ends, y FROM m")
def market_load(spark, sf):
    return settled(spark, sf).select("market_id", "category", six(F.col("price")).alias("price"), "active", F.round("liquidity", 4).alias("liquidity"), F.col("ends").cast("timestamp_ntz").alias("ends"), "y")


@query(_MARKETS + """, c AS (SELECT category, count(*) AS n_total, count(*) FILTER (active = 1) AS n_active, 100 * avg(CASE WHEN active = 1 THEN coalesce(price < 0.1, false)::INT END) AS longshot_pct,
    100 * avg(CASE WHEN active = 1 THEN coalesce(price > 0.35 AND price < 0.65, false)::INT END) AS tossup_pct, median(liquidity) FILTER (active = 1) AS med_liquidity FROM m GROUP BY category HAVING count(*) FILTER (active = 1) >= 20),
    l AS (SELECT *, log10(greatest(med_liquidity, 1)) AS ll, CASE category WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 3 WHEN 'STANDARD' THEN 2 WHEN 'MEDIUM' THEN 2 WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 0 ELSE 1 END AS modelability FROM c),
    e AS (SELECT *, round_even((ll - min(ll) OVER ()) / (max(ll) OVER () - min(ll) OVER ()), 2) AS efficiency FROM l)
    SELECT category, n_total, n_active, modelability, round(longshot_pct, 6) AS longshot_pct, round(tossup_pct, 6) AS tossup_pct, round(med_liquidity, 6) AS med_liquidity, efficiency,
    round_even(modelability / 3 * (1 - efficiency) * (0.5 + 0.5 * tossup_pct / max(tossup_pct) OVER ()), 3) AS ripeness FROM e""")
def market_categories(spark, sf):
    """Categories of active markets: how modelable, how efficient by depth, how much undecided, and so how ripe."""
    m = settled(spark, sf)
    on, x = F.col("active") == 1, F.col("price")
    pct = lambda cond: 100 * F.avg(F.when(on, F.coalesce(cond, F.lit(False)).cast("int")))
    c = m.groupBy("category").agg(F.count("*").alias("n_total"), F.count_if(on).alias("n_active"), pct(x < 0.1).alias("longshot_pct"), pct((x > 0.35) & (x < 0.65)).alias("tossup_pct"), F.median(F.when(on, F.col("liquidity"))).alias("med_liquidity")).where("n_active >= 20")
    whole = Window.partitionBy(F.lit(0))  # a row a category
    ll = F.log10(F.greatest("med_liquidity", F.lit(1.0)))
    known = F.create_map(*[F.lit(v) for kv in MODELABLE.items() for v in kv])
    c = c.withColumns({"modelability": F.coalesce(F.try_element_at(known, F.col("category")), F.lit(1)), "efficiency": F.bround((ll - F.min(ll).over(whole)) / (F.max(ll).over(whole) - F.min(ll).over(whole)), 2)})
    ripe = F.col("modelability") / 3 * (1 - F.col("efficiency")) * (0.5 + 0.5 * F.col("tossup_pct") / F.max("tossup_pct").over(whole))
    return c.select("category", "n_total", "n_active", "modelability", *[six(F.col(k)).alias(k) for k in ("longshot_pct", "tossup_pct", "med_liquidity")], "efficiency", F.bround(ripe, 3).alias("ripeness"))


@query(_MARKETS + f""", f AS (SELECT l_partkey AS market_id, median(round(l_discount * 10, 4)) AS fc FROM lineitem WHERE l_returnflag IN ('N', 'A') GROUP BY 1), j AS (SELECT fc, y FROM m JOIN f USING (market_id) WHERE active = 0 AND y IS NOT NULL AND ends > TIMESTAMP '{CUT}' AND fc > 0.02 AND fc < 0.98)
    SELECT CASE WHEN fc < 0.2 THEN 0 WHEN fc < 0.4 THEN 1 WHEN fc < 0.6 THEN 2 WHEN fc < 0.8 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(fc), 6) AS forecast, round(avg(y), 6) AS settled, round(avg(pow(fc - y, 2)), 6) AS brier FROM j GROUP BY 1""")
def market_calibration(spark, sf):
    """Settled markets that end after the cut: the median price of their yes side against what came, by bin."""
    yes = tables.market_prices(spark, sf).where(F.lower("outcome") == "yes").groupBy("market_id").agg(F.median("price").alias("fc"))
    m = settled(spark, sf).where(f"active = 0 and y is not null and ends > timestamp '{CUT}'").join(yes, "market_id").where("fc > 0.02 and fc < 0.98")
    b = scalar.calibration_bin(F.col("fc"), 5).alias("bin")
    return m.groupBy(b).agg(F.count("*").alias("n"), six(F.avg("fc")).alias("forecast"), six(F.avg("y")).alias("settled"), six(F.avg(F.pow(F.col("fc") - F.col("y"), 2))).alias("brier"))


_PHASES = "CASE WHEN week <= 1 THEN '1' WHEN week <= 4 THEN '2-4' WHEN week <= 9 THEN '5-9' WHEN week <= 13 THEN '10-13' ELSE '14+' END AS band, CASE WHEN week <= 1 THEN '1' WHEN week <= 4 THEN '2-4' WHEN week <= 9 THEN '5-9' ELSE '10+' END AS phase, CASE WHEN week <= 3 THEN '0-3' WHEN week <= 8 THEN '4-8' ELSE '9+' END AS third"


@query(P + f" SELECT band, phase, third, model, {_METRICS} FROM (SELECT *, {_PHASES} FROM predictions) GROUP BY band, phase, third, model")
def metrics_by_phase(spark, sf):
    """Metrics by the three bandings of a season's weeks."""
    p = predictions(spark, sf).withColumns({"band": scalar.week_band(F.col("week")), "phase": scalar.week_phase(F.col("week")), "third": scalar.week_third(F.col("week"))})
    return rounded(evaluate.metrics(p, "band", "phase", "third"), "acc", "logloss", "brier")


_DIS = "dis AS (SELECT *, abs(p - mp) AS conf, (((p >= 0.5)::INT = home_win))::INT AS m_right FROM (SELECT game_id, week, home_win, spread_home, 1 / (1 + pow(10, -(home_pregame_elo - away_pregame_elo + CASE WHEN neutral_site THEN 0 ELSE 55 END) / 400)) AS p, 1 / (1 + exp(spread_home / 7)) AS mp FROM lined) WHERE p IS NOT NULL AND mp IS NOT NULL AND (p >= 0.5) <> (mp >= 0.5))"


def _cut(name, column, edges):
    cases = " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '({lo:g},{hi:g}]'" for lo, hi in zip(edges, edges[1:]))
    return f"SELECT '{name}' AS by, CASE {cases} END AS bin, count(*) AS n, round(avg(m_right) * 100, 1) AS model_right FROM dis GROUP BY 2"


#: The three tables of win rates on disagreements: descriptor and right-closed edges.
WINRATES = (("spread", "abs(spread_home)", (0.0, 3.0, 7.0, 14.0, 100.0)), ("week", "week", (0, 3, 8, 60)), ("conviction", "conf", (0.0, 0.05, 0.1, 0.2, 1.0)))


@query(P + ", " + _DIS + " SELECT * FROM (" + " UNION ALL ".join(_cut(*w) for w in WINRATES) + ") WHERE bin IS NOT NULL")
def winrate_tables(spark, sf):
    """Where model and market disagree: how often the model is right, by the line, the week and its conviction."""
    rows = lines.lined_games(games(spark, sf), line_odds(spark, sf))
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    rows = rows.withColumns({"p": scalar.win_probability(edge), "mp": scalar.sigmoid(-F.col("spread_home") / 7)}).where("p is not null and mp is not null and (p >= 0.5) <> (mp >= 0.5)")
    rows = rows.withColumns({"spread": F.abs("spread_home"), "conviction": F.abs(F.col("p") - F.col("mp")), "right": ((F.col("p") >= 0.5).cast("int") == F.col("home_win")).cast("int")})
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("by"), scalar.right_closed(F.col(n), e).alias("bin")) for n, _, e in WINRATES])).alias("x")
    long = rows.select("right", one).select("right", "x.*").where("bin is not null")
    return long.groupBy("by", "bin").agg(F.count("*").alias("n"), F.round(F.avg("right") * 100, 1).alias("model_right"))


@query(P + _ERAS + f""", d AS (SELECT game_id, season, home_win, max(CASE WHEN model = 'opening' THEN p END) AS o FROM predictions GROUP BY ALL HAVING max(CASE WHEN model = 'opening' THEN p END) IS NOT NULL),
    x AS (SELECT era, model, count(*) AS n_era, count(p) AS n, avg({_LL.format('p')}) FILTER (p IS NOT NULL) AS logloss, avg({_LL.format('p')} - ({_LL.format('o')})) FILTER (p IS NOT NULL) AS vs_open FROM d JOIN (SELECT game_id, model, p FROM predictions) USING (game_id) JOIN eras ON season BETWEEN a AND z GROUP BY era, model)
    SELECT era, model, n, round(logloss, 6) AS logloss, round(vs_open, 6) + 0.0 AS vs_open FROM x WHERE n >= 0.5 * n_era""")
def matched_logloss(spark, sf):
    """Log loss against the opening line on the games that a model and the line have, for models that cover half of an era."""
    p = predictions(spark, sf)
    o = p.where("model = 'opening' and p is not null").select("game_id", F.col("p").alias("o"))
    rows = evaluate.with_eras(p.join(o, "game_id"))
    own, line = scalar.log_loss(F.col("p"), F.col("home_win")), scalar.log_loss(F.col("o"), F.col("home_win"))
    out = rows.groupBy("era", "model").agg(F.count("*").alias("n_era"), F.count("p").alias("n"), F.avg(own).alias("logloss"), F.avg(F.when(F.col("p").isNotNull(), own - line)).alias("vs_open"))
    return rounded(out.where("n >= 0.5 * n_era"), "logloss", "vs_open").drop("n_era")


@query(P + f" SELECT week, count(*) AS n, round(avg({_LL.format('a')}), 6) AS prior, round(avg({_LL.format('b')}), 6) AS market, round(avg({_LL.format('a')} - {_LL.format('b')}), 6) AS gap FROM (SELECT game_id, week, home_win, max(CASE WHEN model = 'prior' THEN p END) AS a, max(CASE WHEN model = 'market' THEN p END) AS b FROM predictions WHERE season_type = 'regular' GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY week HAVING count(*) >= 40")
def week_gap_table(spark, sf):
    """Log loss of two forecasts by week on the games that have both, and the gap between them."""
    rows = lines.lined_games(games(spark, sf), line_odds(spark, sf)).where("season_type = 'regular'")
    edge = F.col("home_pregame_elo") - F.col("away_pregame_elo") + F.when(F.col("neutral_site"), 0).otherwise(55)
    rows = rows.withColumns({"a": scalar.win_probability(edge), "b": scalar.sigmoid(-F.col("spread_home") / 7)}).where("a is not null and b is not null")
    a, b = scalar.log_loss(F.col("a"), F.col("home_win")), scalar.log_loss(F.col("b"), F.col("home_win"))
    return rows.groupBy("week").agg(F.count("*").alias("n"), six(F.avg(a)).alias("prior"), six(F.avg(b)).alias("market"), six(F.avg(a - b)).alias("gap")).where("n >= 40")


@query(_BETS + """, base AS (SELECT spread_home, margin, home_win, home_odds, away_odds FROM lined LEFT JOIN ml USING (game_id) WHERE spread_home IS NOT NULL),
    b AS (SELECT 'home_ats' AS rule, CASE WHEN margin + spread_home = 0 THEN 0.0 WHEN margin + spread_home > 0 THEN 100 / 1.1 ELSE -100.0 END AS profit FROM base
      UNION ALL SELECT 'favourite_ml', CASE WHEN spread_home < 0 THEN CASE WHEN home_win = 1 THEN 100 * (home_odds - 1) WHEN home_odds IS NOT NULL THEN -100.0 END ELSE CASE WHEN home_win = 0 THEN 100 * (away_odds - 1) WHEN away_odds IS NOT NULL THEN -100.0 END END FROM base
      UNION ALL SELECT 'underdog_ml', CASE WHEN spread_home >= 0 THEN CASE WHEN home_win = 1 THEN 100 * (home_odds - 1) WHEN home_odds IS NOT NULL THEN -100.0 END ELSE CASE WHEN home_win = 0 THEN 100 * (away_odds - 1) WHEN away_odds IS NOT NULL THEN -100.0 END END FROM base)
    SELECT rule, count(profit) AS n, round(avg(profit) / 100, 6) AS roi FROM b GROUP BY rule""")
def naive_baselines(spark, sf):
    """What betting without a model makes: every home side against the spread, favourites, underdogs."""
    odds = line_odds(spark, sf)
    rows = lines.lined_games(games(spark, sf), odds).where("spread_home is not null").join(lines.moneylines(odds), "game_id", "left")
    cover, won, fav = F.col("margin") + F.col("spread_home"), F.col("home_win") == 1, F.col("spread_home") < 0
    side = lambda home: F.when(home, F.when(won, 100 * (F.col("home_odds") - 1)).when(F.col("home_odds").isNotNull(), -100.0)).otherwise(F.when(~won, 100 * (F.col("away_odds") - 1)).when(F.col("away_odds").isNotNull(), -100.0))
    made = (("home_ats", F.when(cover == 0, 0.0).when(cover > 0, 100 / 1.1).otherwise(-100.0)), ("favourite_ml", side(fav)), ("underdog_ml", side(~fav)))
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), p.alias("profit")) for n, p in made])).alias("b")).select("b.*")
    return long.groupBy("rule").agg(F.count("profit").alias("n"), six(F.avg("profit") / 100).alias("roi"))
