"""Batch rating systems over a history window: edges and PageRank, ridge ratings, Bradley-Terry, Blade-Chest."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions.scalar import decay
from paceline.operators import sparse
from paceline.operators.passes import few_blocks
from paceline.sources.tables import staged

EDGE_KINDS = ("win", "margin", "points", "points_against", "points_keep")


def edges(g: DataFrame, kind: str, weight: Column | None = None, cap: float = 28.0) -> DataFrame:
    """Directed weighted edges of games: src gives dst its weight. Zero weights are no edges; parallel ones stay."""
    w = F.lit(1.0) if weight is None else weight
    h, a, hp, ap = (F.col(c) for c in ("home_team", "away_team", "home_points", "away_points"))
    edge = lambda s, d, x: F.struct(s.alias("src"), d.alias("dst"), x.cast("double").alias("w"))
    loser, winner = F.when(hp > ap, a).otherwise(h), F.when(hp > ap, h).otherwise(a)
    made = {
        "win": [edge(loser, winner, w)],
        "margin": [edge(loser, winner, w * (1 + F.least(F.abs(hp - ap), F.lit(cap))))],
        "points": [edge(h, a, w * (ap + 1)), edge(a, h, w * (hp + 1))],
        "points_against": [edge(h, a, w * ap), edge(a, h, w * hp)],
        "points_keep": [edge(h, a, w * ap), edge(a, h, w * hp), edge(h, h, w * hp), edge(a, a, w * ap)],
    }[kind]
    keep = [c for c in ("season", "period") if c in g.columns]
    return g.select(*keep, F.explode(F.array(*made)).alias("e")).select(*keep, "e.*").where("w > 0")


def calendar(g: DataFrame) -> DataFrame:
    """Each period with the newest season among earlier games: decay counts from there. The first period has none."""
    from pyspark.sql import Window

    p = g.select("season", "period").distinct()
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("hist_season", F.max("season").over(before)).where("hist_season is not null")


def history_sums(stats: DataFrame, cal: DataFrame, keys: list[str], values: list[str], rate: float, back: int = 6) -> DataFrame:
    """Decayed sums of ``stats(season, period, keys, values)`` over the ``back`` seasons before each period's history.

    Decay depends on seasons only, so complete seasons are summed once and weighted by season; only games of the
    newest season are joined with its periods.
    """
    sums = [F.sum(v).alias(v) for v in values]
    whole = stats.groupBy("season", *keys).agg(*sums)
    seasons = cal.select("hist_season").distinct()
    far = whole.join(F.broadcast(seasons), (F.col("season") < F.col("hist_season")) & (F.col("season") >= F.col("hist_season") - back))  # a row a season
    far = far.select("hist_season", *keys, *[(F.col(v) * decay(rate, F.col("hist_season") - F.col("season"))).alias(v) for v in values]).groupBy("hist_season", *keys).agg(*sums)
    old = far.join(cal.select("period", "hist_season"), "hist_season").select("period", *keys, *values)
    c = cal.select(F.col("period").alias("p"), "hist_season")
    now = stats.join(c, (F.col("season") == F.col("hist_season")) & (F.col("period") < F.col("p"))).select(F.col("p").alias("period"), *keys, *values)
    return old.unionByName(now).groupBy("period", *keys).agg(*sums)


def history_join(g: DataFrame, cal: DataFrame, rate: float, back: int = 6) -> DataFrame:
    """Every period with all games of its window and their weights: the plain form, and the twin of ``history_sums``."""
    c = cal.select(F.col("period").alias("at"), "hist_season")
    near = (F.col("period") < F.col("at")) & (F.col("season") >= F.col("hist_season") - back)
    return g.join(F.broadcast(c), near).withColumn("weight", decay(rate, F.col("hist_season") - F.col("season")))  # a row a period


def ranks(s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int, damping: float = 0.85, rounds: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Power iteration of the column-normalised graph of ``n`` nodes; nodes without outflow give to all."""
    out = np.bincount(s, w, n)
    flow = w / out[s]
    sinks = out == 0
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        new = damping * (np.bincount(d, flow * r[s], n) + r[sinks].sum() / n) + (1 - damping) / n
        new /= new.sum()
        done = np.abs(new - r).sum() < tol
        r = new
        if done:
            break
    return r


def pagerank_values(src: np.ndarray, dst: np.ndarray, w: np.ndarray, damping: float = 0.85, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Names and ranks of a graph given by names."""
    names, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return names, ranks(flat[: len(src)], flat[len(src) :], w, len(names), damping, rounds, tol)


def pagerank(window_edges: DataFrame, damping: float = 0.85, rounds: int = 200) -> DataFrame:
    """``(period, src, dst, w)`` to the log-rank of every team in every period."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, r = pagerank_values(pdf["src"].to_numpy(), pdf["dst"].to_numpy(), pdf["w"].to_numpy(), damping, rounds)
        return pd.DataFrame({"period": int(pdf["period"].iloc[0]), "team": names, "rank": r, "log_rank": np.log(np.maximum(r, 1e-12))})

    return window_edges.groupBy("period").applyInPandas(run, "period int, team string, rank double, log_rank double")


#: Edges of a piece at most: those of a hub are several.
HUB = 100_000
#: Rounds of one job, parts of nodes a task, and edges of a task at least.
AT_ONCE, PARTS, LEAST = 10, 4, 50_000


def pagerank_joined(e: DataFrame, damping: float = 0.85, rounds: int = 200, tol: float = 1e-10, hub: int | None = None) -> DataFrame:
    """``e(src, dst, w)`` to (team, rank) by power iteration: no graph in a task, however large.

    Nodes are dealt to parts, and a part's ranks are one array. The edges of a part's nodes are pieces of ``hub`` edges at
    most, arrays as well, dealt out once by part, and stay so; a round joins them with the ranks, adds up what goes to each
    node in a task, 8 bytes a node, and then the tasks' arrays by part. That is all that is shuffled, whatever edges there
    are. What nodes without outflow hold goes to all: where there are such, it is summed each round. Ranks sum to one;
    rounds end where no more than ``tol`` moves, which is looked at, and the plan cut, every AT_ONCE rounds.
    """
    hub = HUB if hub is None else hub
    spark = e.sparkSession
    e = staged(e.select("src", "dst", F.col("w").cast("double").alias("w")))
    total = e.groupBy("src").agg(F.sum("w").alias("out"))
    count = e.count()
    width = max(1, min(2 * spark.sparkContext.defaultParallelism, count // LEAST))
    names = e.select(F.col("src").alias("team")).union(e.select(F.col("dst").alias("team"))).distinct().join(total.withColumnRenamed("src", "team"), "team", "left")
    at = F.row_number().over(Window.partitionBy("part").orderBy("team")) - 1
    nodes = staged(names.withColumn("part", F.pmod(F.xxhash64("team"), F.lit(PARTS * width)).cast("int")).select("team", "out", "part", at.alias("at")))
    sizes = {r["part"]: (r["n"], r["sinks"]) for r in nodes.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("out").isNull()).alias("sinks")).collect()}  # a row a part
    n, sinks = (sum(v[k] for v in sizes.values()) for k in (0, 1))
    if not n:
        return nodes.select("team", F.lit(1.0).alias("rank"))
    begin, ends = {}, 0
    for p in sorted(sizes):
        begin[p], ends = ends, ends + sizes[p][0]
    with _dealt(spark, width):
        source = nodes.select(F.col("team").alias("src"), "out", "part", F.col("at").alias("a"))
        offset = F.element_at(F.create_map(*[F.lit(v) for p in begin for v in (p, begin[p])]), F.col("part"))
        target = nodes.select(F.col("team").alias("dst"), (offset + F.col("at")).alias("b"))
        flows = e.join(source, "src").join(target, "dst").select("part", "a", "b", (F.col("w") / F.col("out")).alias("flow"))
        pieces = staged(flows.mapInArrow(lambda batches: _pieces(batches, hub), "part int, a binary, b binary, flow binary").repartition(width, "part"))
    own = lambda df, run: df.mapInArrow(run, "part int, x double").agg(F.sum("x")).first()[0] or 0.0
    sink = staged(nodes.groupBy("part").applyInArrow(_sinks, "part int, sink binary")) if sinks else None
    even = lambda t: pa.table({"part": t.column("part")[:1], "v": pa.array([np.full(len(t), 1.0 / n).tobytes()], pa.binary())})
    r = staged(nodes.groupBy("part").applyInArrow(even, "part int, v binary"))
    step = 1 if sinks else AT_ONCE

    def came(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            b, x = [], []
            for _, i, j, flow, v in zip(*batch.columns):
                b.append(np.frombuffer(j.as_buffer(), np.int32))
                x.append(np.frombuffer(flow.as_buffer()) * np.frombuffer(v.as_buffer())[np.frombuffer(i.as_buffer(), np.int32)])
            if b:
                new = np.bincount(np.concatenate(b), np.concatenate(x), n)
                got = new if got is None else got + new
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array(list(begin), pa.int32()), pa.array([got[k : k + sizes[p][0]].tobytes() for p, k in begin.items()], pa.binary())], names=["part", "v"])

    def ranking(lost: float):
        def ranked(t: pa.Table) -> pa.Table:
            v = (1 - damping) / n + damping * (sum(np.frombuffer(x.as_buffer()) for x in t.column("v")) + lost / n)
            return pa.table({"part": t.column("part")[:1], "v": pa.array([v.tobytes()], pa.binary())})

        return ranked

    for done in range(0, rounds, step):
        before = r
        with _dealt(spark, width), few_blocks(e):
            lost = own(r.join(sink, "part").select("part", "v", "sink"), _held) if sinks else 0.0
            ranked = ranking(lost)
            for _ in range(min(step, rounds - done)):
                r = pieces.join(r.hint("shuffle_hash"), "part").select("part", "a", "b", "flow", "v").mapInArrow(came, "part int, v binary").groupBy("part").applyInArrow(ranked, "part int, v binary")
            r = staged(r)
            if done + step < rounds and own(r.join(before.withColumnRenamed("v", "old"), "part").select("part", "v", "old"), _moved) < tol * step:
                break
    schema = nodes.select("team", F.lit(0.0).alias("rank")).schema
    return nodes.select("part", "at", "team").groupBy("part").cogroup(r.groupBy("part")).applyInArrow(_unpacked, schema)


@contextmanager
def _dealt(spark: SparkSession, width: int) -> Iterator[None]:
    """Plans run herein shuffle to ``width`` parts, so that what is dealt out so stays where it is."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(width))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (part, a, b, flow) as rows of arrays, those of a part together, ``most`` of them or fewer."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}

    def made(part: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        cut = [[c[lo : lo + most].tobytes() for lo in range(0, len(c), most)] for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(cut[0]), pa.int32()), *[pa.array(c, pa.binary()) for c in cut]], names=["part", "a", "b", "flow"])

    for batch in batches:
        part, a, b, flow = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(part, kind="stable")
        part, a, b, flow = part[order], a[order].astype(np.int32), b[order].astype(np.int32), flow[order]
        ends = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        for lo, hi in zip(ends, ends[1:]):
            if hi > lo:
                rows = held.setdefault(int(part[lo]), [])
                rows.append((a[lo:hi], b[lo:hi], flow[lo:hi]))
                if sum(len(x[0]) for x in rows) >= most:
                    yield made(int(part[lo]), [np.concatenate(c) for c in zip(*held.pop(int(part[lo])))])
    for part, rows in held.items():
        yield made(part, [np.concatenate(c) for c in zip(*rows)])


def _sinks(t: pa.Table) -> pa.Table:
    """Which of a part's nodes have no outflow, in their order."""
    gone = np.zeros(len(t), bool)
    gone[t.column("at").to_numpy()] = np.isnan(t.column("out").to_numpy())
    return pa.table({"part": t.column("part")[:1], "sink": pa.array([gone.tobytes()], pa.binary())})


def _of_parts(each, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(each(x.as_buffer(), y.as_buffer())) for x, y in zip(batch.column(1), batch.column(2))], pa.float64())], names=["part", "x"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _of_parts(lambda v, sink: np.frombuffer(v)[np.frombuffer(sink, bool)].sum(), batches)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _of_parts(lambda v, old: np.abs(np.frombuffer(v) - np.frombuffer(old)).sum(), batches)


def _unpacked(nodes: pa.Table, ranks: pa.Table) -> pa.Table:
    return pa.table({"team": nodes.column("team"), "rank": pa.array(np.frombuffer(ranks.column("v")[0].as_buffer())[nodes.column("at").to_numpy()])})


def pair_stats(g: DataFrame, target: Column, weight: Column | None = None) -> DataFrame:
    """Sufficient statistics of ridge ratings by (season, period, home, away): sums of weights and weighted targets."""
    w = F.lit(1.0) if weight is None else weight
    ind = (~F.col("neutral_site")).cast("double")
    rows = g.where(target.isNotNull())
    return rows.groupBy("season", "period", "home_team", "away_team").agg(
        F.sum(w).alias("w"), F.sum(w * ind).alias("wi"), F.sum(w * target).alias("wy"), F.sum(w * ind * target).alias("wiy"), F.sum(F.lit(1.0)).alias("n")
    )


@dataclass
class Teams:
    """Teams of pairs: sorted names, both sides as numbers of them, and their places among ``total`` of a block of periods."""

    names: np.ndarray
    first: np.ndarray
    second: np.ndarray
    place: np.ndarray | None = None
    total: int = 0


def teams(pdf: pd.DataFrame, first: str = "home_team", second: str = "away_team") -> Teams:
    """The teams of two columns. Categories that both share, as blocks of periods have, are numbers already."""
    a, b = pdf[first], pdf[second]
    if not isinstance(a.dtype, pd.CategoricalDtype):
        names, flat = np.unique(np.concatenate([a.to_numpy(str), b.to_numpy(str)]), return_inverse=True)
        return Teams(names, flat[: len(pdf)], flat[len(pdf) :])
    h, v = a.cat.codes.to_numpy(), b.cat.codes.to_numpy()
    total = len(a.cat.categories)
    seen = np.zeros(total, bool)
    seen[h] = seen[v] = True
    at = np.cumsum(seen) - 1
    return Teams(a.cat.categories.to_numpy(str)[seen], at[h], at[v], np.flatnonzero(seen), total)


class Memory:
    """Solutions of a block's last period, by name, as starts of the next one's: a vector a team, and what isn't a team's."""

    def __init__(self):
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.parts: dict[str, Memory] = {}

    def of(self, name: str) -> Memory:
        """A memory of its own for one of several systems."""
        return self.parts.setdefault(name, Memory())

    def start(self, name: str, t: Teams) -> np.ndarray | None:
        if name not in self.known or t.place is None:
            return None
        by_team, rest = self.known[name]
        return np.concatenate([by_team[:, t.place].reshape(-1, *by_team.shape[2:]), rest])

    def keep(self, name: str, t: Teams, x: np.ndarray, blocks: int = 1) -> None:
        if t.place is not None:
            n = len(t.names)
            by_team = np.zeros((blocks, t.total, *x.shape[1:]))
            by_team[:, t.place] = x[: blocks * n].reshape(blocks, n, *x.shape[1:])
            self.known[name] = (by_team, x[blocks * n :])


def ridge_fit(t: Teams, at_home: np.ndarray, w: np.ndarray, wy: np.ndarray, lam: float, memory: Memory | None = None, name: str = "") -> np.ndarray:
    """Ratings and home advantage that minimise the weighted squares plus ``lam`` times the ratings' squares. Columns of
    ``wy`` are several targets of the same games: one matrix, several right sides."""
    d = sparse.Differences(t.first, t.second, at_home, len(t.names))
    x = sparse.solve(d, w, d.sums(wy), np.r_[np.full(d.n, lam), 1e-6], memory.start(name, t) if memory else None)
    if memory:
        memory.keep(name, t, x)
    return x


def ridge_solution(pdf: pd.DataFrame, lam: float, memory: Memory | None = None, name: str = "ridge") -> tuple[np.ndarray, np.ndarray, float]:
    """Teams, ratings and home advantage of a frame with w, wi, wy, wiy: sums of weights and weighted targets, and of
    those of games at home."""
    t = teams(pdf)
    w, wi, wy, wiy = (pdf[c].to_numpy(float) for c in ("w", "wi", "wy", "wiy"))
    both = Teams(t.names, np.r_[t.first, t.first], np.r_[t.second, t.second], t.place, t.total)
    x = ridge_fit(both, np.r_[np.ones(len(pdf)), np.zeros(len(pdf))], np.r_[wi, w - wi], np.r_[wiy, wy - wiy], lam, memory, name)
    return t.names, x[:-1], float(x[-1])


def ridge(window_stats: DataFrame, lam: float = 4.0, least: int = 50) -> DataFrame:
    """Ridge ratings per period, with the home advantage as team ``*``; none for windows under ``least`` games."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, r, hfa = ridge_solution(pdf, lam)
        return pd.DataFrame({"period": int(pdf["period"].iloc[0]), "team": [*names, "*"], "rating": [*r, hfa]})

    enough = window_stats.groupBy("period").agg(F.sum("n").alias("games")).where(F.col("games") >= least)
    return window_stats.join(enough.select("period"), "period", "left_semi").groupBy("period").applyInPandas(run, "period int, team string, rating double")


def sides_fit(t: Teams, at_home: np.ndarray, w: np.ndarray, home_points: np.ndarray, away_points: np.ndarray, lam: float = 6.0, memory: Memory | None = None, name: str = "sides") -> np.ndarray:
    """Offences, defences, level and home bonus of points ~ level + offence - defence + home bonus of the teams of
    weighted games: both sides' points are rows. Offence and defence are penalised."""
    d = sparse.Sides(np.r_[t.first, t.second], np.r_[t.second, t.first], np.r_[at_home, np.zeros(len(at_home))], len(t.names))
    x = sparse.solve(d, np.r_[w, w], d.sums(np.r_[home_points, away_points]), np.r_[np.full(2 * d.n, lam), 1e-8, 1e-8], memory.start(name, t) if memory else None)
    if memory:
        memory.keep(name, t, x, 2)
    return x


def off_def_solution(pdf: pd.DataFrame, lam: float = 6.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Teams, offence, defence, level and home bonus of rows team, opp, home, w and wp, the weights and weighted points
    of a team's games against another."""
    t = teams(pdf, "team", "opp")
    w, wp, home = (pdf[c].to_numpy(float) for c in ("w", "wp", "home"))
    d = sparse.Sides(t.first, t.second, home, len(t.names))
    x = sparse.solve(d, w, d.sums(wp), np.r_[np.full(2 * d.n, lam), 1e-8, 1e-8])
    return t.names, x[: d.n], x[d.n : 2 * d.n], float(x[-2]), float(x[-1])


def strength_fit(t: Teams, at_home: np.ndarray, w: np.ndarray, y: np.ndarray, reg: float = 3.0, memory: Memory | None = None, name: str = "strength") -> np.ndarray:
    """Strengths and home edge of the weighted logistic likelihood with squared strengths penalised. ``y``: shares of wins."""
    d = sparse.Differences(t.first, t.second, at_home, len(t.names))
    x = sparse.logistic(d, w, y, np.r_[np.full(d.n, reg), 0.0], memory.start(name, t) if memory else None)
    if memory:
        memory.keep(name, t, x)
    return x


def bradley_terry_solution(pdf: pd.DataFrame, reg: float = 3.0, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Teams, strengths and home edge of games or pairs with weight, home_win and neutral_site."""
    t = teams(pdf)
    x = strength_fit(t, 1.0 - pdf["neutral_site"].to_numpy(float), pdf["weight"].to_numpy(float), pdf["home_win"].to_numpy(float), reg, memory)
    return t.names, x[:-1], float(x[-1])


def minimise(f, x: np.ndarray, rounds: int = 200, memory: int = 10, tol: float = 1e-7) -> np.ndarray:
    """L-BFGS with backtracking for ``f(x) -> (value, gradient)``."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, stack = grad.copy(), []
        for s, t in reversed(past):
            alpha = s @ q / (t @ s)
            q -= alpha * t
            stack.append(alpha)
        if past:
            s, t = past[-1]
            q *= s @ t / (t @ t)
        for (s, t), alpha in zip(past, reversed(stack), strict=True):
            q += s * (alpha - t @ q / (t @ s))
        slope, step = grad @ q, 1.0 if past else min(1.0, 1 / (np.abs(grad).sum() + 1e-12))
        while True:
            new = x - step * q
            v, g = f(new)
            if v <= value - 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, t = new - x, g - grad
        x, done = new, np.abs(g).max() < tol or abs(value - v) < 1e-12 * (1 + abs(v))
        value, grad = v, g
        if s @ t > 1e-12:
            past = (past + [(s, t)])[-memory:]
        if done:
            break
    return x


#: Rows that are taken at once, at least: their arrays stay in a core's cache.
CHUNK = 8192


def blade_chest_loss(x: np.ndarray, h: np.ndarray, a: np.ndarray, ind: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, dim: int, reg: float) -> tuple[float, np.ndarray]:
    """Penalised loss and gradient of p = sigmoid(blade_h.chest_a - blade_a.chest_h + s_h - s_a + edge * home).

    Rows are taken in chunks that stay in a core's cache and dimensions one by one, so that all arrays are contiguous; both
    sides of each are looked up once for the loss and the gradient, and these share one exponential.
    """
    b, c, s = x[: n * dim].reshape(n, dim).T.copy(), x[n * dim : 2 * n * dim].reshape(n, dim).T.copy(), x[2 * n * dim : -1]
    gb, gc, gs = reg * b, reg * c, reg * s
    loss, edge = reg / 2 * (x[:-1] ** 2).sum(), 0.0
    size = max(CHUNK, 4 * n)  # a sum by team is as long as the teams, whatever the rows
    for lo in range(0, len(h), size):
        part = slice(lo, lo + size)
        i, j, at_home, wins, weight = h[part], a[part], ind[part], y[part], w[part]
        z = s[i] - s[j] + x[-1] * at_home
        sides = []
        for d in range(dim):
            bi, bj, ci, cj = b[d][i], b[d][j], c[d][i], c[d][j]
            z += bi * cj - bj * ci
            sides.append((bi, bj, ci, cj))
        small = np.exp(-np.abs(z))
        loss += (weight * (np.log1p(small) + np.maximum(z, 0.0) - wins * z)).sum()
        r = weight * (np.where(z >= 0, 1.0, small) / (1 + small) - wins)
        for d, (bi, bj, ci, cj) in enumerate(sides):
            gb[d] += np.bincount(i, r * cj, n) - np.bincount(j, r * ci, n)
            gc[d] += np.bincount(j, r * bi, n) - np.bincount(i, r * bj, n)
        gs += np.bincount(i, r, n) - np.bincount(j, r, n)
        edge += (r * at_home).sum()
    return loss, np.concatenate([gb.T.ravel(), gc.T.ravel(), gs, [edge]])


def blade_chest_solution(pdf: pd.DataFrame, dim: int = 3, reg: float = 1.0, seed: int = 0, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Teams, blades, chests, strengths and home edge. The loss isn't convex: a period starts from the last one's
    solution in ``memory``, and teams that it hasn't from seeded draws."""
    t = teams(pdf)
    n = len(t.names)
    first = np.concatenate([0.1 * np.random.default_rng(seed).standard_normal((n, 2 * dim)), np.zeros((n, 1))], axis=1)
    edge = 0.3
    if memory and t.place is not None and "blade_chest" in memory.known:
        table, (edge,) = memory.known["blade_chest"]
        seen = table[t.place].any(axis=1)
        first[seen] = table[t.place][seen]
    start = np.concatenate([first[:, :dim].ravel(), first[:, dim : 2 * dim].ravel(), first[:, -1], [edge]])
    y, ind = pdf["home_win"].to_numpy(float), 1.0 - pdf["neutral_site"].to_numpy(float)
    args = (t.first, t.second, ind, y, pdf["weight"].to_numpy(float), n, dim, reg)
    x = minimise(lambda v: blade_chest_loss(v, *args), start)
    blade, chest, strength = x[: n * dim].reshape(n, dim), x[n * dim : 2 * n * dim].reshape(n, dim), x[2 * n * dim : -1]
    if memory and t.place is not None:
        table = np.zeros((t.total, 2 * dim + 1))
        table[t.place] = np.concatenate([blade, chest, strength[:, None]], axis=1)
        memory.known["blade_chest"] = (table, x[-1:])
    return t.names, blade, chest, strength, float(x[-1])


def calibration_fit(diff: np.ndarray, ind: np.ndarray | None, y: np.ndarray, w: np.ndarray, c: float = 1.0) -> np.ndarray:
    """Intercept and coefficients (of ``diff`` and, if given, ``ind``) of a logistic fit, the coefficients' squares over
    2c penalised; of one class: a constant. ``y`` may be shares of wins, as the likelihood is linear in them."""
    x = np.column_stack([np.ones_like(diff), diff] + ([] if ind is None else [ind]))
    if y[w > 0].min(initial=1.0) == y[w > 0].max(initial=0.0) and y[w > 0].min(initial=1.0) in (0.0, 1.0):
        return np.array([30.0 if y[w > 0].min() else -30.0] + [0.0] * (x.shape[1] - 1))
    b, pen = np.zeros(x.shape[1]), np.array([0.0] + [1 / c] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-12), x.T @ (w * (y - p)) - pen * b)
        b += step
        if np.abs(step).max() < 1e-10:
            break
    return b


def rated(g: DataFrame, ratings: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Games with both sides' ratings of their period as home_ and away_ columns: a team without them takes the
    period's medians. Periods without ratings have no rows."""
    own = ratings.where("team <> '*'")
    base = own.groupBy("period").agg(*[F.median(v).alias(f"base_{v}") for v in values])
    out = g.join(base, "period")
    for s in ("home", "away"):
        out = out.join(own.select("period", F.col("team").alias(f"{s}_team"), *[F.col(v).alias(f"own_{v}") for v in values]), ["period", f"{s}_team"], "left")
        out = out.withColumns({f"{s}_{v}": F.coalesce(f"own_{v}", f"base_{v}") for v in values}).drop(*[f"own_{v}" for v in values])
    return out.drop(*[f"base_{v}" for v in values])
