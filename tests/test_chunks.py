"""Histories in chunks: fits are those of whole frames, and a task's memory doesn't grow with its history."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from paceline.operators import chunks, ratings, snapshot, walkforward
from test_walkforward import GAMES, league


@pytest.fixture(scope="module")
def games(spark):
    return spark.createDataFrame(league(), GAMES)


def rows(n, teams, seasons=3, seed=0):
    """Games as values of ``walkforward.pair_values``, in batches."""
    rng = np.random.default_rng(seed)
    for lo in range(0, n, 10_000):
        k = min(10_000, n - lo)
        h = rng.integers(0, teams, k)
        a = (h + rng.integers(1, teams, k)) % teams
        hp, ap = rng.integers(1, 50, k), rng.integers(50, 99, k) - 50 * rng.integers(0, 2, k)
        m = np.where(hp == ap, 1, hp - ap).astype(float)
        period = rng.integers(0, 4 * seasons, k)
        v = {"n": np.ones(k), "y": (m > 0) * 1.0, "m": m.clip(-28, 28), "hp": hp * 1.0, "ap": ap * 1.0, "hh": hp**2.0, "aa": ap**2.0, "e": rng.random(k), "em": rng.normal(size=k), "z": (rng.random(k) < 0.1) * 1.0, "zm": np.zeros(k)}
        v |= {f"m{c}": m.clip(-c, c) for c in (14, 50)} | {f"{s}{c}": np.where((m > 0) == (s == "h"), 1 + np.abs(m).clip(max=c), 0) for c in (14, 28, 45) for s in "ha"}
        name = lambda x: [f"S{i}" for i in x]
        yield pa.RecordBatch.from_pydict({"season": pa.array(2000 + period // 4, pa.int32()), "period": pa.array(period, pa.int32()), "home_team": name(h), "away_team": name(a), "neutral_site": rng.random(k) < 0.3, **v})


def both(columns, season, periods, n=3000, teams=40):
    """Each period's history in chunks, and as a frame by pair."""
    values = sorted({v for v, _ in columns.values()})
    batches = [b for b in rows(n, teams)]
    g = chunks.Gathered(season, values)
    keep = [b.filter(pa.compute.less_equal(b["season"], season)) for b in batches]
    for b in keep:
        g.add(b)
    g.done()
    for p, frame in walkforward.accumulated(pa.Table.from_batches(keep), season, columns, periods):
        yield g.before(p, columns), frame


@pytest.fixture
def small(monkeypatch):
    """Chunks of few rows, all of them in files."""
    monkeypatch.setattr(chunks, "ROWS", 300)
    monkeypatch.setattr(chunks, "HELD", 0)


def test_fits_in_chunks_are_those_of_frames(small):
    columns = {c: (c, 0.5) for c in ("n", "y", "m", "hp", "ap")} | {"count": ("n", 1.0), "none": ("n", 0.0)}
    memory = ratings.Memory()
    for h, frame in both(columns, 2002, [9, 10, 11]):
        w = frame["n"].to_numpy()
        assert len(h.chunks) > 1 and h.sum("count") == pytest.approx(frame["count"].sum()) and h.sum("none") == pytest.approx(frame["none"].sum())
        for got, want in (
            (walkforward.ridge(h, "n", "m", 4.0, memory), ratings.ridge_solution(walkforward.ridge_frame(frame, "n", "m"), 4.0)),
            (walkforward.strengths(h, 3.0, memory), ratings.bradley_terry_solution(frame.assign(weight=w, home_win=frame["y"] / w))),
        ):
            assert list(got[0]) == list(want[0]) and got[1] == pytest.approx(want[1], abs=1e-8) and got[2] == pytest.approx(want[2], abs=1e-8)
        t = ratings.teams(frame)
        want = ratings.sides_fit(t, 1.0 - frame["neutral_site"].to_numpy(float), w, frame["hp"].to_numpy(), frame["ap"].to_numpy())
        assert np.r_[h.named((x := chunks.sides_fit(h, "n", "hp", "ap", 6.0))[: len(h.names)], h.seen())[1], x[-2:]] == pytest.approx(np.r_[want[: len(t.names)], want[-2:]], abs=1e-8)
        d = np.random.default_rng(1).normal(size=len(h.names))
        at = np.searchsorted(h.names[h.order], t.names)
        of = d[h.order][at]
        want = ratings.calibration_fit(of[t.first] - of[t.second], 1.0 - frame["neutral_site"].to_numpy(float), frame["y"].to_numpy() / w, w)
        assert chunks.calibration_fit(h, "n", "y", lambda p: d[p.first] - d[p.second], True) == pytest.approx(want, abs=1e-8)


@pytest.mark.parametrize("kind", ["win", "margin14", "margin", "points", "points_against", "points_keep"])
def test_ranks_in_chunks_are_those_of_frames(small, kind):
    columns = {c: (c, 0.0) for c in ("n", "y", "hp", "ap", "h14", "a14", "h28", "a28")}  # the newest season alone: some teams have no edge
    for h, frame in both(columns, 2002, [9, 11], 400, 90):
        got, want = walkforward.log_ranks(h, kind), walkforward.log_ranks(frame, kind)
        assert list(got[0]) == list(want[0]) and got[1] == pytest.approx(want[1], abs=1e-8)
        assert 0 < len(got[0]) < len(h.names)


def test_what_is_kept_is_exact(small):
    store = chunks.Store()
    for a in (np.array([1.0, -2, 127]), np.array([1.0, 40000]), np.array([0.1, 0.25]), np.array([0.25, 0.5]), np.array([1e300, 1.0]), np.array([np.nan, 1.0]), np.array([7.0, 7.0]), np.array([True, False]), np.array([np.inf, 2.0])):
        k = store.put(chunks.narrow(a))
        assert np.array_equal(np.broadcast_to(store.get(k), len(a)).astype(float), a.astype(float), equal_nan=True)
    assert [chunks.narrow(np.array(a)).itemsize for a in ([1.0, 2.0], [0.25, 0.5], [0.1, 0.2])] == [1, 4, 8]


def peak(run, new):
    """Bytes that numpy and Arrow hold at most while a task goes through half a million games of 3,000 teams."""
    added = pa.RecordBatch.from_pydict({"new": pa.array([new])}).column("new")

    def batches():
        for b in rows(500_000, 3000):
            yield b.append_column("new", pa.nulls(len(b), added.type))
            most.append(pa.total_allocated_bytes())
        last = {f.name: pa.nulls(1, f.type) for f in b.schema}
        yield pa.RecordBatch.from_pydict(last | {"new": added})

    most = [pa.total_allocated_bytes()]
    tracemalloc.start()
    try:
        assert sum(len(b) for b in run(batches()))
        return tracemalloc.get_traced_memory()[1] + max(most) - most[0]
    finally:
        tracemalloc.stop()


NEW = {"game_id": 1, "period": 11, "home_team": "S1", "away_team": "S2", "neutral_site": False, "home_win": 1, "season": 2002, "scale": 1.0}
CASES = {
    "features": (lambda g: snapshot.features(g), ("game_id", "season", "period", "home_team", "away_team", "neutral_site", "scale")),
    "ranks": (lambda g: walkforward.weekly(g, {f"cap{c}": walkforward.pagerank_system(f"margin{c}") for c in (14, 28, 45)}), ("game_id", "period", "home_team", "away_team", "neutral_site", "home_win")),
    "strengths": (lambda g: walkforward.weekly(g, {f"bt{r}": walkforward.bradley_terry_system(r) for r in (0.3, 0.5, 0.7)}, back=1000), ("game_id", "period", "home_team", "away_team", "neutral_site", "home_win")),
    "ridges": (lambda g: walkforward.weekly(g, {"ridge_margin": walkforward.ridge_system()}), ("game_id", "period", "home_team", "away_team", "neutral_site", "home_win")),
}


@pytest.mark.parametrize("case", CASES)
def test_a_task_does_not_hold_its_history(games, monkeypatch, case):
    """A task held all rows, then sums by pair in a column a system, and copies of both: 150 MB and more here."""
    run, (make, fields) = [], CASES[case]
    real = type(games).mapInArrow
    monkeypatch.setattr(type(games), "mapInArrow", lambda self, f, *args, **kw: run.append(f) or real(self, f, *args, **kw))
    monkeypatch.setattr(ratings, "calendar", lambda g: g.sparkSession.createDataFrame([(2002, 11, 2002)], "season int, period int, hist_season int"))
    make(games)
    assert peak(run[-1], {k: NEW[k] for k in fields}) < 75e6
