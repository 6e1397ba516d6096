"""Walk-forward refits: every period's history as sums over pairs of teams, systems fitted on them, games predicted.

A system sees a period's history as one row a pair (home, away, neutral) with decayed sums, never as games: all its
likelihoods and normal equations are linear in them. For systems they are added up within blocks of periods
(``by_period``), sums by team in windows (``running``); ``history`` has them as one table, which grows with the periods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import clipped, decay
from paceline.operators import chunks, ratings
from paceline.sources.tables import stored

PAIR = ["home_team", "away_team", "neutral_site"]
#: Half-life in days of recent form, and the age of a game without a date.
HALF_LIFE, UNDATED = 45.0, 400
#: Margin caps of the rated margin, its variants, and the edges of margin graphs.
CAP, CAPS, EDGE_CAPS = 28.0, (14.0, 50.0), (14.0, 28.0, 45.0)


def pair_sums(g: DataFrame, cap: float = CAP, by: list[str] = PAIR) -> DataFrame:
    """``pair_values`` summed by (season, period, home, away, neutral), or by other keys than a pair's."""
    values = pair_values(g, cap, by)
    return values.groupBy("season", "period", *by).agg(*[F.sum(c).alias(c) for c in values.columns if c not in ("season", "period", *by)])


def pair_values(g: DataFrame, cap: float = CAP, by: list[str] = PAIR) -> DataFrame:
    """A game's share in the sums by (season, period, home, away, neutral) that any system of this module needs. Hardly two
    games of a period are of one pair, so where histories are added up anyway (``by_period``) games are taken as they are:
    no shuffle.

    n games, y home wins; m margins under ``cap``, m14 and m50 under others; hp, ap points and hh, aa their squares; h14.. and a14..
    edge weights of home and away wins; e and em games and margins weighed by two to the days since ``START`` over the
    half-life, which is recency up to a factor that a period has; z and zm those without a date.
    """
    margin = F.col("margin").cast("double")
    age = F.pow(F.lit(2.0), F.datediff("start_date", F.lit(START).cast("date")) / HALF_LIFE)
    one, home, dated = F.lit(1.0), F.col("home_win") == 1, F.col("start_date").isNotNull()
    cut = lambda c: clipped(margin, -c, c)
    edge = lambda won, c: F.when(won, 1 + F.least(F.abs(margin), F.lit(c))).otherwise(0.0)
    sums: dict[str, Column] = {"n": one, "y": F.col("home_win").cast("double"), "m": cut(cap), "hp": F.col("home_points").cast("double"), "ap": F.col("away_points").cast("double")}
    sums |= {f"m{c:.0f}": cut(c) for c in CAPS}
    sums |= {"hh": F.pow("home_points", F.lit(2.0)), "aa": F.pow("away_points", F.lit(2.0))}
    sums |= {f"{s}{c:.0f}": edge(won, c) for c in EDGE_CAPS for s, won in (("h", home), ("a", ~home))}
    sums |= {"e": F.when(dated, age).otherwise(0.0), "em": F.when(dated, age * cut(cap)).otherwise(0.0)}
    sums |= {"z": F.when(dated, 0.0).otherwise(1.0), "zm": F.when(dated, 0.0).otherwise(cut(cap))}
    return g.select("season", "period", *by, *[c.alias(k) for k, c in sums.items()])


#: Recency is counted from here: powers of two of the days since, over the half-life, stay finite for 120 years.
START = "1990-01-01"


def history(sums: DataFrame, cal: DataFrame, columns: dict[str, tuple[str, float]], back: int = 6) -> DataFrame:
    """(period, pair, columns): each column a sum decayed by its own rate over the ``back`` seasons before a period's
    newest season, and that season's periods before it; a rate of 1 just adds up.

    Whole seasons are summed and decayed once for all periods of a season; only the newest season's rows meet their
    periods.
    """
    values = sorted({v for v, _ in columns.values()})
    whole = sums.groupBy("season", *PAIR).agg(*[F.sum(v).alias(v) for v in values])
    seasons = cal.select("hist_season").distinct()
    ago = F.col("hist_season") - F.col("season")
    far = whole.join(F.broadcast(seasons), (ago > 0) & (ago <= back))  # a row a season
    far = far.select("hist_season", *PAIR, *[(F.col(v) * decay(r, ago)).alias(k) for k, (v, r) in columns.items()])
    far = far.groupBy("hist_season", *PAIR).agg(*[F.sum(k).alias(k) for k in columns])
    old = far.join(cal.select("period", "hist_season"), "hist_season").select("period", *PAIR, *columns)
    c = cal.select(F.col("period").alias("p"), "hist_season")
    now = sums.join(c, (F.col("season") == F.col("hist_season")) & (F.col("period") < F.col("p")))
    now = now.select(F.col("p").alias("period"), *PAIR, *[F.col(v).alias(k) for k, (v, _) in columns.items()])
    return old.unionByName(now).groupBy("period", *PAIR).agg(*[F.sum(k).alias(k) for k in columns])


def steps(sums: DataFrame, cal: DataFrame, keys: list[str], columns: dict[str, tuple[str, float]], back: int = 6) -> DataFrame:
    """(hist_season, since, keys, columns): what periods of one newest season of history have by key from its begin, since
    -1, the earlier seasons decayed, and what each period of that season adds. So a row is there once for each season that it
    is history of, not once a period."""
    values = sorted({v for v, _ in columns.values()})
    seasons = F.broadcast(cal.select("hist_season").distinct())
    add = lambda df, *by: df.groupBy(*by, *keys).agg(*[F.sum(v).alias(v) for v in values])
    ago = F.col("hist_season") - F.col("season")
    far = add(sums, "season").join(seasons, (ago > 0) & (ago <= back)).withColumn("since", F.lit(-1))  # a row a season
    now = add(sums, "season", "period").join(seasons, ago == 0).withColumnRenamed("period", "since")
    every = [df.select("hist_season", "since", *keys, *[(F.col(v) * decay(r, ago)).alias(k) for k, (v, r) in columns.items()]) for df in (far, now)]
    # the newest season's rows are one a period and key already: only the earlier ones are added up again
    return every[0].groupBy("hist_season", "since", *keys).agg(*[F.sum(k).alias(k) for k in columns]).unionByName(every[1])


def running(made: DataFrame, cal: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(period, keys, names): sums of ``steps`` from a season's begin to each of its periods that the calendar has."""
    own = Window.partitionBy("hist_season", *keys).orderBy("since")
    ends = cal.groupBy("hist_season").agg(F.min("period").alias("from"), F.max("period").alias("upto"))
    rows = made.select("hist_season", "since", *keys, F.lead("since").over(own).alias("next"), *[F.sum(c).over(own).alias(c) for c in names]).join(F.broadcast(ends), "hist_season")  # a row a season
    lo, hi = F.greatest(F.col("since") + 1, "from"), F.coalesce("next", "upto")
    rows = rows.where(lo <= hi).select("hist_season", *keys, *names, F.explode(F.sequence(lo, hi)).alias("period"))
    return rows.join(F.broadcast(cal.select("hist_season", "period")), ["hist_season", "period"]).select("period", *keys, *names)  # a row a period


#: Periods of a season that one task fits one after another; its history is sent to it once.
SPAN = 8


def blocked(cal: DataFrame) -> DataFrame:
    """The calendar with ``block``, a number for SPAN periods of equal newest season, and ``last``, a block's last period."""
    own = Window.partitionBy("hist_season")  # a row a period
    cal = cal.withColumn("block", F.col("hist_season") * 1000 + F.floor((F.col("period") - F.min("period").over(own)) / SPAN).cast("int"))
    return cal.withColumn("last", F.max("period").over(Window.partitionBy("block")))


#: Arrow types of the columns that fits return.
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}


def by_period(sums: DataFrame, cal: DataFrame, columns: dict[str, tuple[str, float]], todo: DataFrame, fit: Callable[[int, pd.DataFrame | chunks.History, pd.DataFrame, ratings.Memory], pd.DataFrame], schema: str, back: int = 6, whole: bool = True) -> DataFrame:
    """``fit(period, pairs, rows, memory)`` for every period of ``todo(period, ...)`` that the calendar has: its history by
    pair, decayed as in ``history``, its rows of ``todo``, and what the block's last period left as starts. Teams are
    categories of the block.

    ``sums`` may have several rows of a pair and period, such as ``pair_values``. They are stored once, a folder a season,
    and the task of a block reads the seasons of its history from there: no history is shuffled or stored again, so what
    lies on disk grows with the sums alone. The task decays the rows and adds them up as it goes on from period to period.
    Unless ``whole``, a fit gets the rows as they are, as a ``chunks.History``, which a task needn't hold.
    """
    values = sorted({v for v, _ in columns.values()})
    cal = blocked(cal)
    blocks = cal.select("block", "hist_season", "last").distinct().orderBy("block").collect()  # a row a block
    kept = stored(sums.select("season", "period", *PAIR, *values), "season")
    new = stored(todo.join(F.broadcast(cal.select("period", "block")), "period").select("block", F.struct(*todo.columns).alias("new")), "block")  # a row a period
    names, types = zip(*[c.split() for c in schema.split(", ")])
    made_of = pa.schema([(n, KINDS[t]) for n, t in zip(names, types, strict=True)])

    def task(season: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, asked, gathered = [], [], chunks.Gathered(season, values)
            keep = rows.append if whole else gathered.add
            for batch in batches:
                own = batch.column("new").is_valid()
                if own.true_count:
                    asked.append(batch.select(["new"]).filter(own))
                if own.true_count < len(own):
                    keep(batch.drop_columns(["new"]).filter(pc.invert(own)))
            new = pa.Table.from_batches(asked)["new"].combine_chunks() if asked else []
            if not len(new):
                return
            new = pa.Table.from_arrays(new.flatten(), names=[f.name for f in new.type])
            del asked
            memory, periods = ratings.Memory(), pc.unique(new["period"]).sort().to_pylist()
            if whole:
                histories = accumulated(pa.Table.from_batches(rows), season, columns, periods)
            else:
                gathered.done()
                histories = ((p, gathered.before(p, columns)) for p in periods)
            for p, own in histories:
                made = fit(p, own, new.filter(pc.equal(new["period"], p)).to_pandas(), memory)
                if len(made):
                    yield from pa.Table.from_pandas(made, made_of, preserve_index=False).to_batches(max_chunksize=10_000)
            gathered.close()

        return run

    none = F.lit(None).cast(new.schema["new"].dataType).alias("new")
    parts = [kept.where(F.col("season") == -1).select("*", none).mapInArrow(task(0), schema)]  # no file: a union of single partitions alone would be one task
    for block, season, last in blocks:
        rows, asked = kept.where(F.col("season").between(season - back, season) & (F.col("period") < last)).select("*", none), new.where(F.col("block") == block).select("new")
        parts.append(rows.unionByName(asked, allowMissingColumns=True).coalesce(1).mapInArrow(task(season), schema))
    return reduce(DataFrame.union, parts)


def accumulated(rows: pa.Table, season: int, columns: dict[str, tuple[str, float]], periods: list[int]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Each of ``periods``, whose newest season of history is ``season``, and the decayed sums by pair of the rows before it.

    Pairs are numbered as they come up, so that a period has the first so many, and its frame is views.
    """
    ago, since = season - rows["season"].to_numpy(), rows["period"].to_numpy()
    order = np.argsort(np.where(ago > 0, -1, since), kind="stable")
    order = order[: np.searchsorted(np.where(ago > 0, -1, since)[order], periods[-1])]
    ago, since = ago[order], np.where(ago > 0, -1, since)[order]
    sides = [rows[c].dictionary_encode().combine_chunks() for c in PAIR[:2]]
    names = np.unique(np.concatenate([d.dictionary.to_numpy(zero_copy_only=False).astype(str) for d in sides]))
    first, second = (np.searchsorted(names, d.dictionary.to_numpy(zero_copy_only=False).astype(str)).astype(np.int64)[d.indices.to_numpy()[order]] for d in sides)
    key = (first * len(names) + second) * 2 + rows[PAIR[2]].to_numpy()[order]
    del first, second, sides
    key, at, code = np.unique(key, return_index=True, return_inverse=True)
    came = np.argsort(at)
    code = np.argsort(came)[code]
    key, begun = key[came], since[at[came]]
    frame = {c: pd.Categorical.from_codes(k, names) for c, k in ((PAIR[0], key // 2 // len(names)), (PAIR[1], key // 2 % len(names)))} | {PAIR[2]: key % 2 == 1}
    own = {v: rows[v].to_numpy()[order] for v in {v for v, _ in columns.values()}}
    table, done = {c: np.zeros(len(key)) for c in columns}, 0
    for p in periods:
        upto, pairs = int(np.searchsorted(since, p)), int(np.searchsorted(begun, p))
        now = slice(done, upto)
        weights = {r: np.power(float(r), ago[now]) for r in {r for _, r in columns.values()}}
        for c, (v, r) in columns.items():
            np.add.at(table[c], code[now], own[v][now] * weights[r])
        done = upto
        yield p, pd.DataFrame({c: v[:pairs] for c, v in (frame | table).items()}, copy=False)


def newest(g: DataFrame, cal: DataFrame) -> DataFrame:
    """(period, scale): what recency sums of a period's history are multiplied by, from its newest date."""
    last = g.groupBy("period").agg(F.max("start_date").alias("d"))
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # a row a period
    last = last.withColumn("ref", F.max("d").over(before))
    days = F.datediff("ref", F.lit(START).cast("date"))
    return cal.select("period").join(last, "period").select("period", F.coalesce(F.pow(F.lit(0.5), days / HALF_LIFE), F.lit(0.0)).alias("scale"))


def nothing(*names: str) -> pd.DataFrame:
    """No rows, of a kind that fits every type."""
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})


def evaluated(g: DataFrame) -> DataFrame:
    """The games that are predicted: both sides of the first division."""
    return g.where("home_division = 'fbs' and away_division = 'fbs'")


@dataclass(frozen=True)
class System:
    """``fit(pairs, memory) -> chance(home, away, at_home) -> (p, margin or None)`` on arrays; ``columns`` it needs, with rates.
    A system that is ``whole`` is given a frame of the pairs of which one of ``weights`` is positive, an other one takes a
    ``chunks.History`` as well and leaves out the others itself."""

    columns: dict[str, tuple[str, float]]
    fit: Callable[[pd.DataFrame | chunks.History, ratings.Memory | None], Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]]]
    weights: tuple[str, ...] = ("n",)
    whole: bool = False


def lookup(names: np.ndarray, values: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Values of teams by sorted names, the median for a team that isn't there."""
    mid = float(np.median(values)) if len(values) else 0.0

    def of(teams: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, teams).clip(max=max(len(names) - 1, 0))
        return np.where(names[at] == teams, values[at], mid) if len(names) else np.full(len(teams), mid)

    return of


def _sides(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pairs["home_team"].to_numpy(str), pairs["away_team"].to_numpy(str), 1.0 - pairs["neutral_site"].to_numpy(float)


def _shares(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the pairs and their weighted shares of home wins: all that a weighted logistic likelihood needs."""
    w = pairs["n"].to_numpy(float)
    return w, pairs["y"].to_numpy(float) / np.where(w > 0, w, 1)


def sent(kind: str) -> Callable[[chunks.Part], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Edges of a history by pairs or games, src and dst as numbers of teams, and their weights; the kinds of
    ``ratings.edges``, ``margin14`` and so on for other caps."""

    def edges(p: chunks.Part) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        h, a = p.first, p.second
        if kind == "win":
            y = p["y"]
            return [(a, h, y), (h, a, p["n"] - y)]
        if kind.startswith("margin"):
            cap = kind[6:] or "28"
            return [(a, h, p[f"h{cap}"]), (h, a, p[f"a{cap}"])]
        hp, ap = p["hp"], p["ap"]
        if kind == "points":
            n = p["n"]
            return [(h, a, ap + n), (a, h, hp + n)]
        return [(h, a, ap), (a, h, hp)] + ([(h, h, hp), (a, a, ap)] if kind == "points_keep" else [])

    return edges


def log_ranks(pairs: pd.DataFrame | chunks.History, kind: str, damping: float = 0.85) -> tuple[np.ndarray, np.ndarray]:
    """Names of the teams that an edge has, and their log-ranks."""
    h = chunks.of(pairs)
    r, seen = chunks.ranks(h, sent(kind), damping)
    return h.named(np.log(np.maximum(r, 1e-12)), seen)


def everywhere(h: chunks.History, names: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``lookup`` of all teams of a history, by number."""
    return lookup(names, values)(h.names)


def pagerank_system(kind: str, rate: float = 0.35, damping: float = 0.85) -> System:
    """Log-ranks, calibrated to chances on the history itself by its pairs."""
    need = {"win": "", "points_against": "hp ap", "points_keep": "hp ap", "points": "hp ap"}.get(kind)
    need = (f"h{kind[6:] or 28} a{kind[6:] or 28}" if need is None else need).split()

    def fit(pairs: pd.DataFrame | chunks.History, memory: ratings.Memory | None = None):
        pairs = chunks.of(pairs)
        solved = log_ranks(pairs, kind, damping)
        value, of = lookup(*solved), everywhere(pairs, *solved)
        b = chunks.calibration_fit(pairs, "n", "y", lambda p: of[p.first] - of[p.second], True)
        return lambda h, a, s: (1 / (1 + np.exp(-(b[0] + b[1] * (value(h) - value(a)) + b[2] * s))), None)

    return System({c: (c, rate) for c in ("n", "y", *need)}, fit)


def strengths(h: chunks.History, reg: float = 3.0, memory: ratings.Memory | None = None, every: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """Teams, strengths and home edge of a history with n and y. Unless ``every``, of teams that a weighed row has."""
    x = chunks.strength_fit(h, "n", "y", reg, memory)
    return *h.named(x[:-1], h.seen() if every else h.seen("n")), float(x[-1])


def ridge(h: chunks.History, weight: str, target: str, lam: float, memory: ratings.Memory | None = None, name: str = "ridge") -> tuple[np.ndarray, np.ndarray, float]:
    """Teams that a weighed row has, their ratings, and home advantage."""
    x = chunks.ridge_fit(h, lambda p: p[weight], lambda p: p[target], lam, memory, name)
    return *h.named(x[:-1], h.seen(weight)), float(x[-1])


def bradley_terry_system(rate: float = 0.35, reg: float = 3.0) -> System:
    def fit(pairs: pd.DataFrame | chunks.History, memory: ratings.Memory | None = None):
        names, s, edge = strengths(chunks.of(pairs), reg, memory)
        value = lookup(names, s)
        return lambda h, a, at_home: (1 / (1 + np.exp(-(value(h) - value(a) + edge * at_home))), None)

    return System({c: (c, rate) for c in ("n", "y")}, fit)


def blade_chest_system(rate: float = 0.35, dim: int = 3, reg: float = 1.0, seed: int = 0) -> System:
    def fit(pairs: pd.DataFrame, memory: ratings.Memory | None = None):
        w, y = _shares(pairs)
        names, blade, chest, s, edge = ratings.blade_chest_solution(pairs.assign(weight=w, home_win=y), dim, reg, seed, memory)
        value = lookup(names, s)

        def vectors(table: np.ndarray, teams: np.ndarray) -> np.ndarray:
            at = np.searchsorted(names, teams).clip(max=len(names) - 1)
            return table[at] * (names[at] == teams)[:, None]  # an unseen team has strength only

        def chance(h, a, at_home):
            inner = (vectors(blade, h) * vectors(chest, a)).sum(1) - (vectors(blade, a) * vectors(chest, h)).sum(1)
            return 1 / (1 + np.exp(-(inner + value(h) - value(a) + edge * at_home))), None

        return chance

    return System({c: (c, rate) for c in ("n", "y")}, fit, whole=True)


def ridge_system(rate: float = 0.35, lam: float = 4.0, target: str = "m") -> System:
    """Ridge ratings of the margin; the predicted margin is calibrated to a chance on the history."""

    def fit(pairs: pd.DataFrame | chunks.History, memory: ratings.Memory | None = None):
        pairs = chunks.of(pairs)
        names, r, hfa = ridge(pairs, "n", target, lam, memory, f"{target}{rate}{lam}")
        value, of = lookup(names, r), everywhere(pairs, names, r)
        margin = lambda h, a, s: value(h) - value(a) + hfa * s
        b = chunks.calibration_fit(pairs, "n", "y", lambda p: of[p.first] - of[p.second] + hfa * p.at_home, False)
        return lambda h, a, s: (1 / (1 + np.exp(-(b[0] + b[1] * margin(h, a, s)))), margin(h, a, s))

    return System({"n": ("n", rate), "y": ("y", rate), target: (target, rate)}, fit)


def with_targets(sums: DataFrame, rows: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """``sums`` or values of pairs and those of ``rows(season, period, pair, targets)``: whether a row has a target, n_target,
    and its value, v_target. A null target is no row of that target and stays one of the others.

    Both are rows of one table: what a pair has of games and of targets is added up where histories are.
    """
    one = lambda t: (F.col(t).isNotNull().cast("double").alias(f"n_{t}"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias(f"v_{t}"))
    own = rows.select("season", "period", *PAIR, *[c for t in targets for c in one(t)])
    both = sums.unionByName(own, allowMissingColumns=True)
    return both.select("season", "period", *PAIR, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in both.columns if c not in ("season", "period", *PAIR)])


def having(sums: DataFrame, targets: Iterable[str]) -> DataFrame:
    """The rows of ``with_targets`` that have one of ``targets``: a ridge of targets alone needs no others."""
    return sums.where(reduce(Column.__or__, [F.col(f"n_{t}") > 0 for t in targets]))


def target_system(target: str, lam: float, rate: float = 0.35, least: int = 50) -> System:
    """Ridge ratings of a target of ``with_targets``, whose rows needn't be games; the predicted target is calibrated to a
    chance on the history's games. Under ``least`` rows of the target the chance is a half and the prediction zero."""

    def fit(pairs: pd.DataFrame | chunks.History, memory: ratings.Memory | None = None):
        pairs = chunks.of(pairs)
        if pairs.sum("rows") < least:
            return lambda h, a, s: (np.full(len(h), 0.5), np.zeros(len(h)))
        names, r, hfa = ridge(pairs, "w", "v", lam, memory, target)
        value, of = lookup(names, r), everywhere(pairs, names, r)
        margin = lambda h, a, s: value(h) - value(a) + hfa * s
        b = chunks.calibration_fit(pairs, "n", "y", lambda p: of[p.first] - of[p.second] + hfa * p.at_home, False)
        return lambda h, a, s: (1 / (1 + np.exp(-(b[0] + b[1] * margin(h, a, s)))), margin(h, a, s))

    return System({"n": ("n", rate), "y": ("y", rate), "w": (f"n_{target}", rate), "v": (f"v_{target}", rate), "rows": (f"n_{target}", 1.0)}, fit, ("n", "w"))


def target_ratings(sums: DataFrame, cal: DataFrame, penalties: dict[str, float], rate: float = 0.35, back: int = 6, least: int = 50) -> DataFrame:
    """(target, period, team, rating), the home advantage as team ``*``: ridges of all targets of ``with_targets`` in every
    period with ``least`` rows of a target before it, in one pass over the history."""
    columns = {f"{k}_{t}": (f"{v}_{t}", r) for t in penalties for k, v, r in (("w", "n", rate), ("v", "v", rate), ("rows", "n", 1.0))}
    sums = having(sums, penalties)

    def fit(period: int, pairs: chunks.History, _: pd.DataFrame, memory: ratings.Memory) -> pd.DataFrame:
        out = [nothing("target", "period", "team", "rating")]
        for t, lam in penalties.items():
            if pairs.sum(f"rows_{t}") >= least:
                names, r, home = ridge(pairs, f"w_{t}", f"v_{t}", lam, memory, t)
                out.append(pd.DataFrame({"target": t, "period": period, "team": [*names, "*"], "rating": [*r, home]}))
        return pd.concat(out[1:] or out)

    return by_period(sums, cal, columns, cal.select("period"), fit, "target string, period int, team string, rating double", back, whole=False)


def residuals(h: chunks.History, weight: str, target: str, solved: pd.Series, predicted: Callable[[np.ndarray], np.ndarray]) -> pd.Series:
    """By team, and for the home advantage ``*``: the sum of ``target - weight * predicted`` over its rows, away as its
    negative, under the ratings ``solved``."""
    x, n, star = solved.reindex(h.names).to_numpy(), len(h.names), solved["*"]
    sums, edge = np.zeros(n), 0.0
    for p in h:
        e = p[target] - p[weight] * predicted(x[p.first] - x[p.second] + star * p.at_home)
        sums += np.bincount(p.first, e, n) - np.bincount(p.second, e, n)
        edge += e @ p.at_home
    names, sums = h.named(sums, h.seen())
    return pd.Series([*sums, edge], [*names, "*"])


def ridge_frame(pairs: pd.DataFrame, weight: str, target: str) -> pd.DataFrame:
    """Pairs as ``ratings.ridge_solution`` takes them."""
    w, wy, at_home = pairs[weight].to_numpy(float), pairs[target].to_numpy(float), 1.0 - pairs["neutral_site"].to_numpy(float)
    return pd.DataFrame({"home_team": pairs["home_team"], "away_team": pairs["away_team"], "w": w, "wi": w * at_home, "wy": wy, "wiy": wy * at_home})


#: The factory hook: systems by name, each with its own decay; more can be put in.
SYSTEMS: dict[str, Callable[[], System]] = {
    **{f"pr_{kind}": lambda kind=kind: pagerank_system(kind) for kind in ratings.EDGE_KINDS},
    "bradley_terry": lambda: bradley_terry_system(0.65),
    "blade_chest": blade_chest_system,
    "ridge_margin": ridge_system,
}


def weekly(g: DataFrame, systems: dict[str, System], games: DataFrame | None = None, least: int = 50, short: float | None = 0.5, back: int = 6, sums: DataFrame | None = None) -> DataFrame:
    """Every system refitted for every period on what is before it: game_id, period, model, home_win, p, margin.

    ``games`` are those predicted (by default those within the first division); all of ``g`` inform, by their pair sums
    or by ``sums``, which may have more. Periods with under ``least`` games of history get ``short`` as chance, or, if
    that is None, no row.
    """
    games = evaluated(g) if games is None else games
    order = {name: k for k, name in enumerate(systems)}
    columns = {f"s{order[name]}_{k}": v for name, s in systems.items() for k, v in s.columns.items()} | {"games": ("n", 1.0)}
    new = games.select("game_id", "period", "home_team", "away_team", "neutral_site", "home_win")

    whole = any(s.whole for s in systems.values())

    def fit(period: int, pairs: pd.DataFrame | chunks.History, new: pd.DataFrame, memories: ratings.Memory) -> pd.DataFrame:
        out = []
        enough = (pairs["games"].sum() if whole else pairs.sum("games")) >= least
        for name, s in systems.items() if enough or short is not None else ():
            p, margin = np.full(len(new), short if short is not None else np.nan), None
            if enough:
                if whole:
                    own = pairs[PAIR].assign(**{k: pairs[f"s{order[name]}_{k}"] for k in s.columns})
                    own = own[(own[list(s.weights)] > 0).any(axis=1)]
                else:
                    own = pairs.having({k: f"s{order[name]}_{k}" for k in s.columns})
                p, margin = s.fit(own, memories.of(name))(*_sides(new))
            margin = np.full(len(new), np.nan) if margin is None else margin
            out.append(pd.DataFrame({"game_id": new["game_id"].to_numpy(), "period": period, "model": [name] * len(new), "home_win": new["home_win"].to_numpy(), "p": p, "margin": margin}))
        return pd.concat(out) if out else nothing("game_id", "period", "model", "home_win", "p", "margin")

    cal = ratings.calendar(g)
    made = by_period(pair_values(g) if sums is None else sums, cal, columns, new, fit, "game_id long, period int, model string, home_win int, p double, margin double", back, whole)
    made = made.withColumn("margin", F.when(~F.isnan("margin"), F.col("margin")))
    if short is None:
        return made
    first = new.join(F.broadcast(cal.select("period")), "period", "left_anti")  # a row a period
    names = F.explode(F.array(*map(F.lit, systems))).alias("model")
    return made.unionByName(first.select("game_id", "period", names, "home_win", F.lit(float(short)).alias("p"), F.lit(None).cast("double").alias("margin")))
