"""Elo over a stream of games: an extension, the engine's batch pass with state between micro-batches.

Within a micro-batch games are put into chronological order; a game that comes after later ones have been played is
rated by the ratings of its arrival, as they are not taken back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paceline.operators.elo import START

_OUT = "league string, game_id long, home_elo double, away_elo double, p double"


def stream_elo(games: DataFrame, k: float = 40.0, hfa: float = 50.0, regress: float = 0.15) -> DataFrame:
    """``games(league, game_id, season, st_order, week, start_date, home_team, away_team, home_win, margin, neutral_site)``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import math

        season, rating = (None, {}) if not state.exists else (lambda s: (s[0], json.loads(s[1])))(state.get)
        g = pd.concat(list(batches)).sort_values(["season", "st_order", "week", "start_date", "game_id"], na_position="last")
        rows: list[tuple[Any, ...]] = []
        for x in g.itertuples():
            if season is not None and x.season > season:
                rating = {t: START + (1 - regress) * (r - START) for t, r in rating.items()}
            season = x.season if season is None else max(season, x.season)
            h, a = rating.get(x.home_team, START), rating.get(x.away_team, START)
            p = 1 / (1 + 10 ** (-(h - a + (0 if x.neutral_site else hfa)) / 400))
            d = k * math.log(abs(x.margin) + 1) * 2.2 / (0.001 * (h - a if x.home_win else a - h) + 2.2) * (x.home_win - p)
            rating[x.home_team], rating[x.away_team] = h + d, a - d
            rows.append((key[0], x.game_id, h, a, p))
        state.update((int(season), json.dumps(rating)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])

    return games.groupBy("league").applyInPandasWithState(run, _OUT, "season int, ratings string", "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums of ``events(ts, event_type, value)`` by window; later events than the watermark are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
