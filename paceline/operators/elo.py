"""Sequential Elo ratings: games by wavefronts, spans of weeks in turn, ratings handed on as a table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.sources.tables import partitioned, staged, stored

START = 1500.0
#: k, home advantage, share regressed before a season, margin multiplier on, fewer games than this take k_early.
PARAMS = "param_id int, k double, hfa double, regress double, mov boolean, early int, k_early double"
TUNED = (0, 40.0, 50.0, 0.15, True, 0, 0.0)
_COLUMNS = ("game_id", "season", "st_order", "week", "start_date", "home_team", "away_team", "home_win", "margin", "neutral_site")
#: Games that a task plays in turn; a week is never cut.
SPAN = 200_000
#: Parameter sets that a task plays side by side.
SETS = 8


def fronts(home: np.ndarray, away: np.ndarray, teams: int) -> Iterator[np.ndarray]:
    """The games, in order, by wavefront: a game's is one after the later of its teams' last ones, so that no team is
    twice in one and all of one can be played at once."""
    last = [0] * teams
    front = np.empty(len(home), np.int64)
    for i, (h, a) in enumerate(zip(home.tolist(), away.tolist())):
        x, y = last[h], last[a]
        front[i] = x = x if x > y else y
        last[h] = last[a] = x + 1
    order = np.argsort(front, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(front[order])) + 1) if len(order) else ()


def play_sets(g: pd.DataFrame, sets: pd.DataFrame, state: pd.DataFrame | None = None, own: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Games in order under several parameter sets at once: ratings of both sides before each game and home win
    probabilities, a row a set; then the teams, their ratings at the end, and their games of the last season.

    ``state``: team, played, season and the sets' ratings as columns r0, r1, ... where an earlier span ended. ``own``:
    the share regressed by (season, team), instead of the sets': one for all sets, or a list with one a set.
    """
    held = [] if state is None else state["team"].tolist()
    sides = np.concatenate([g["home_team"].to_numpy(str), g["away_team"].to_numpy(str), np.array(held, str)])
    names, flat = np.unique(sides, return_inverse=True) if len(sides) else (np.empty(0, str), np.empty(0, int))
    n, m = len(g), len(sets)
    home, away, known = flat[:n], flat[n : 2 * n], flat[2 * n :]
    k, hfa, regress, k_early = (sets[c].to_numpy(float)[:, None] for c in ("k", "hfa", "regress", "k_early"))
    mov, early = sets["mov"].to_numpy(bool)[:, None], sets["early"].to_numpy(int)[:, None]
    size = np.log(np.abs(g["margin"].to_numpy(float)) + 1) * 2.2
    at_home, wins, seasons = ~g["neutral_site"].to_numpy(bool), g["home_win"].to_numpy(float), g["season"].to_numpy()
    rating, played, season = np.full((m, len(names)), START), np.zeros(len(names), np.int64), None
    if len(held):
        rating[:, known] = np.stack([state[f"r{j}"].to_numpy(float) for j in range(m)])
        played[known], season = state["played"].to_numpy(int), int(state["season"].iloc[0])
    before_h, before_a, chance = np.empty((m, n)), np.empty((m, n)), np.empty((m, n))
    begins = np.flatnonzero(np.r_[True, seasons[1:] != seasons[:-1]]) if n else []
    for a, z in zip(begins, [*begins[1:], n]):
        if season is not None and seasons[a] != season:
            back = regress
            if own is not None:
                shares = [own.get((seasons[a], t)) for t in names]
                there = np.array([x is not None for x in shares], bool)
                back = np.repeat(regress, len(names), axis=1)
                if there.any():
                    back[:, there] = np.stack([np.broadcast_to(x, m) for x in shares if x is not None], axis=1)
            rating, played = START + (1 - back) * (rating - START), np.zeros(len(names), np.int64)
        season = seasons[a]
        for at in fronts(home[a:z], away[a:z], len(names)):
            at = at + a
            h, v, y = home[at], away[at], wins[at]
            rh, ra = rating[:, h], rating[:, v]
            d = rh - ra
            p = 1 / (1 + 10 ** (-(d + at_home[at] * hfa) / 400))
            step = np.where(np.minimum(played[h], played[v]) < early, k_early, k)
            step = np.where(mov, step * size[at] / (0.001 * np.where(y > 0, d, -d) + 2.2), step)
            before_h[:, at], before_a[:, at], chance[:, at] = rh, ra, p
            rating[:, h], rating[:, v] = rh + step * (y - p), ra - step * (y - p)
            played[h] += 1
            played[v] += 1
    return before_h, before_a, chance, names.tolist(), rating, played


def play(g: pd.DataFrame, k: float, hfa: float, regress: float, mov: bool, early: int = 0, k_early: float = 0.0, own: dict | None = None):
    """Ratings before each game of a chronologically sorted frame, home win probabilities, and the ratings at the end."""
    one = pd.DataFrame({"k": [k], "hfa": [hfa], "regress": [regress], "mov": [mov], "early": [early], "k_early": [k_early]})
    h, a, p, names, rating, _ = play_sets(g, one, own=own)
    return h[0].tolist(), a[0].tolist(), p[0].tolist(), dict(zip(names, rating[0].tolist()))


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["season", "st_order", "week", "start_date", "game_id"], na_position="last", ignore_index=True)


def spans(g: DataFrame, size: int) -> DataFrame | None:
    """``g`` as a table by ``span``, whole weeks in order, cut where about ``size`` games are reached; None if one span
    has all. What is counted on the driver is a row a week."""
    week = ["season", "st_order", "week"]
    rows = g.groupBy(*week).agg(F.count("*").alias("n")).orderBy(*week).collect()
    ends = np.cumsum([0, *(r["n"] for r in rows)])[:-1] // size
    if len(set(ends.tolist())) < 2:
        return None
    per = g.sparkSession.createDataFrame([(r["season"], r["st_order"], r["week"], int(k)) for r, k in zip(rows, ends)], "season_of int, st_order_of int, week_of int, span int")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in week]
    return partitioned(g.join(F.broadcast(per), same).select(*g.columns, "span"), "span")  # a row a week


#: Predictions have a game_id; where ratings end there are a team, its ratings as home_elo, and its games of the season. Arrays
#: have a number for each of a task's sets, in order.
_MADE = "task int, game_id long, home_elo array<double>, away_elo array<double>, p array<double>, team string, played int, season int"
_MANY = pa.list_(pa.float64())
_MADE_TYPES = pa.schema(list(zip([c.split()[0] for c in _MADE.split(", ")], (pa.int32(), pa.int64(), _MANY, _MANY, _MANY, pa.string(), pa.int32(), pa.int32()))))
_BESIDE = "kind string, task int, param_id int, k double, hfa double, regress double, mov boolean, early int, k_early double, team string, ratings array<double>, played int, season int"


def _beside(df: DataFrame, kind: str) -> DataFrame:
    """``df`` with the columns of _BESIDE, null where it lacks one."""
    types = dict(c.split() for c in _BESIDE.split(", "))
    own = {**{c: F.col(c).cast(types[c]) for c in df.columns}, "kind": F.lit(kind)}
    return df.select(*[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def _arrays(x: np.ndarray) -> pa.Array:
    """Each column of ``x`` as an array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(x.shape[1] + 1, dtype=np.int32) * x.shape[0]), pa.array(np.ascontiguousarray(x.T).ravel()))


def _span_played(games: DataFrame, sets: DataFrame, state: DataFrame | None, regress: DataFrame | None, sides: bool = True) -> DataFrame:
    """One span: its games under every set, a task for SETS of them. Rows with a game are predictions, those with a team
    are where its ratings end; a row has all sets of its task. ``sides``: with both ratings before a game."""
    left = games.select(*_COLUMNS).join(F.broadcast(sets.select("task").distinct()))  # a row for SETS sets
    beside = _beside(sets, "set")
    if state is not None:
        beside = beside.unionByName(_beside(state, "state"))
    if regress is not None:
        shares = regress if "param_id" in regress.columns else regress.join(F.broadcast(sets.select("param_id")))  # a row a set
        beside = beside.unionByName(_beside(shares.select("param_id", "season", "team", "regress").join(F.broadcast(sets.select("param_id", "task")), "param_id"), "share"))

    by_team = regress is not None

    def run(games: pa.Table, beside: pa.Table) -> pa.Table:
        task = beside["task"][0].as_py()
        games, beside = _sorted(games.to_pandas()), beside.to_pandas()
        sets, before, shares = (beside[beside["kind"] == kind] for kind in ("set", "state", "share"))
        sets, start, own = sets.sort_values("param_id"), None, None
        if len(before):
            table = np.stack(before["ratings"].to_list(), axis=1)
            start = pd.DataFrame({"team": before["team"].to_numpy(), "played": before["played"].to_numpy(), "season": before["season"].to_numpy()} | {f"r{j}": r for j, r in enumerate(table)})
        if by_team:
            wide = shares.pivot(index=["season", "team"], columns="param_id", values="regress").reindex(columns=sets["param_id"])
            wide = wide.fillna(sets.set_index("param_id")["regress"])
            own = {(int(s), t): x for (s, t), x in zip(wide.index, wide.to_numpy(float), strict=True)}
        h, a, p, names, rating, played = play_sets(games, sets, start, own)
        made = lambda rows, **own: pa.table([own.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in _MADE_TYPES], schema=_MADE_TYPES)
        n, m = len(games), len(names)
        whole = lambda x, rows: pa.array(np.full(rows, x))
        both = {"home_elo": _arrays(h), "away_elo": _arrays(a)} if sides else {}
        game = made(n, task=whole(task, n), game_id=pa.array(games["game_id"].to_numpy()), p=_arrays(p), **both)
        end = made(m, task=whole(task, m), home_elo=_arrays(rating), team=pa.array(names), played=pa.array(played), season=whole(int(games["season"].iloc[-1]) if n else 0, m))
        return pa.concat_tables([game, end])

    return left.groupBy("task").cogroup(beside.groupBy("task")).applyInArrow(run, _MADE)


def _by_set(made: DataFrame, sets: DataFrame, keys: list[str], **arrays: str) -> DataFrame:
    """Rows of tasks as a row a set: param_id, keys, and ``name=array`` columns."""
    ids = F.broadcast(sets.groupBy("task").agg(F.sort_array(F.collect_list("param_id")).alias("ids")))  # a row for SETS sets
    rows = made.join(ids, "task").select(*keys, F.inline(F.arrays_zip("ids", *arrays.values())))
    return rows.select(F.col("ids").alias("param_id"), *keys, *[F.col(a).alias(n) for n, a in arrays.items()])


def _played(g: DataFrame, params: DataFrame, regress: DataFrame | None = None, size: int | None = None, sides: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions of all games under all sets, and the ratings at the end, as rows of tasks; and the sets with their tasks.

    Games are cut into spans of whole weeks. Spans are played one after another, each by tasks that have its games only;
    teams' ratings go from span to span as a table, a row a team for SETS sets. So what a task holds is bounded by a span and
    the teams, and the number of jobs is games / SPAN.
    """
    sets = params.withColumn("task", F.floor((F.row_number().over(Window.orderBy("param_id")) - 1) / SETS).cast("int"))  # a row a set
    own = stored(g.select(*_COLUMNS))
    cut = spans(own, size or SPAN)
    if cut is None:
        out = _span_played(own, sets, None, regress, sides)
        return out.where("team is null"), out.where("team is not null"), sets
    sets, regress = staged(sets), None if regress is None else staged(regress)
    made, state = [], None
    for k in range(cut.agg(F.max("span")).first()[0] + 1):
        done = stored(_span_played(cut.where(F.col("span") == k), sets, state, regress, sides))
        state = done.where("team is not null").select("task", "team", F.col("home_elo").alias("ratings"), "played", "season")
        made.append(done)
    return reduce(DataFrame.unionByName, made).where("team is null"), made[-1].where("team is not null"), sets


def pregame(g: DataFrame, params: DataFrame, size: int | None = None) -> DataFrame:
    """Per parameter set and game: probability and both ratings before the game."""
    made, _, sets = _played(g, params, size=size)
    return _by_set(made, sets, ["game_id"], home_elo="home_elo", away_elo="away_elo", p="p")


def chances(g: DataFrame, params: DataFrame, size: int | None = None, beside: DataFrame | None = None) -> DataFrame:
    """``pregame`` without the ratings, which aren't stored then: param_id, game_id, p. ``beside(game_id, ...)``: only its
    games, with its columns, joined before a game has a row a set."""
    made, _, sets = _played(g, params, size=size, sides=False)
    made = made if beside is None else made.join(beside, "game_id")
    return _by_set(made, sets, ["game_id"] if beside is None else beside.columns, p="p")


def final(g: DataFrame, params: DataFrame, size: int | None = None) -> DataFrame:
    """Ratings after the last game."""
    _, ends, sets = _played(g, params, size=size)
    return _by_set(ends, sets, ["team"], rating="home_elo")


def pregame_by_team(g: DataFrame, regress: DataFrame, k: float = 40.0, hfa: float = 50.0, default: float = 0.15, size: int | None = None, sets: int | None = None) -> DataFrame:
    """Elo whose pre-season regression is a team's own: ``regress(season, team, regress)``; with ``sets``, so many that differ
    in it are played side by side, told apart by ``param_id``, from 0 on, there and in the result."""
    same = g.sparkSession.createDataFrame([(i, k, hfa, default, True, 0, 0.0) for i in range(sets or 1)], PARAMS)
    made, _, tasks = _played(g, same, regress, size)
    return _by_set(made, tasks, ["game_id"], home_elo="home_elo", away_elo="away_elo", p="p").select(*(["param_id"] if sets else []), "game_id", "home_elo", "away_elo", "p")


def grid(spark, ks=(25.0, 40.0, 55.0), hfas=(50.0, 65.0, 80.0), regresses=(0.05, 0.10, 0.15, 0.25, 0.40)) -> DataFrame:
    rows = [(i, k, h, r, True, 0, 0.0) for i, (k, h, r) in enumerate((k, h, r) for k in ks for h in hfas for r in regresses)]
    return spark.createDataFrame(rows, PARAMS)
