"""Sparse fits against dense solutions, warm starts against cold ones, and leagues that no dense matrix of a task could hold."""

import resource

import numpy as np
import pandas as pd
import pytest

from paceline.operators import ratings, sparse, walkforward


def pairs(n, rows, seed=0):
    rng = np.random.default_rng(seed)
    h = rng.integers(0, n, rows)
    a = (h + rng.integers(1, n, rows)) % n
    return h, a, rng.integers(0, 2, rows).astype(float), rng.random(rows) + 0.1, rng.standard_normal(rows) * 14, rng.random(rows)


def dense(design, rows):
    return np.stack([design.rows(e) for e in np.eye(design.unknowns)], axis=1)


@pytest.mark.parametrize("kind", [sparse.Differences, sparse.Sides])
def test_solution_equals_the_dense_one(kind):
    h, a, home, w, y, _ = pairs(40, 300)
    d = kind(h, a, home, 40)
    penalty = np.r_[np.full(d.unknowns - 1, 4.0), 1e-6] if kind is sparse.Differences else np.r_[np.full(80, 6.0), 1e-8, 1e-8]
    m = dense(d, 300)
    want = np.linalg.solve((m * w[:, None]).T @ m + np.diag(penalty), m.T @ (w * y))
    got = sparse.solve(d, w, d.sums(w * y), penalty)
    assert got == pytest.approx(want, abs=1e-8)
    assert d.squares(w) == pytest.approx(((m * m) * w[:, None]).sum(0))
    assert sparse.solve(d, w, d.sums(w * y), penalty, want + 0.1) == pytest.approx(want, abs=1e-8)


def test_several_right_sides_at_once():
    h, a, home, w, y, z = pairs(30, 200)
    d, penalty = sparse.Differences(h, a, home, 30), np.r_[np.full(30, 4.0), 1e-6]
    both = sparse.solve(d, w, d.sums(np.stack([w * y, w * z, 0 * w], axis=1)), penalty)
    for k, target in enumerate((y, z, 0 * y)):
        assert both[:, k] == pytest.approx(sparse.solve(d, w, d.sums(w * target), penalty), abs=1e-9)


def test_logistic_gradient_is_zero_from_any_start():
    h, a, home, w, _, share = pairs(25, 200)
    d, penalty = sparse.Differences(h, a, home, 25), np.r_[np.full(25, 3.0), 0.0]
    cold = sparse.logistic(d, w, share, penalty)
    m = dense(d, 200)
    assert m.T @ (w * (share - 1 / (1 + np.exp(-m @ cold)))) - penalty * cold == pytest.approx(np.zeros(26), abs=1e-8)
    for start in (cold + 0.2, 30 * np.random.default_rng(1).standard_normal(26)):
        assert sparse.logistic(d, w, share, penalty, start) == pytest.approx(cold, abs=1e-8)
    assert np.isfinite(sparse.logistic(d, w, np.ones(200), penalty)[:25]).all()


def frame(n, rows, seed, names):
    h, a, home, w, y, share = pairs(n, rows, seed)
    teams = pd.Categorical.from_codes(h, names), pd.Categorical.from_codes(a, names)
    return pd.DataFrame({"home_team": teams[0], "away_team": teams[1], "neutral_site": 1 - home, "n": w, "m": w * y, "y": w * share})


def test_memory_changes_steps_and_not_solutions(monkeypatch):
    """Teams that come and go between periods; a start from the last period saves steps."""
    names = [f"t{k:03d}" for k in range(60)]
    memory, system, strengths = ratings.Memory(), walkforward.ridge_system(), walkforward.bradley_terry_system()
    new = (np.array(["t001", "nobody", "t030"]), np.array(["t002", "t003", "nobody"]), np.array([1.0, 0.0, 1.0]))
    for n in (30, 45, 60, 50):
        own = frame(n, 400, 7, names)
        for s in (system, strengths):
            assert s.fit(own, memory)(*new)[0] == pytest.approx(s.fit(own)(*new)[0], abs=1e-9)
    asked = []
    real = sparse.Differences.rows
    monkeypatch.setattr(sparse.Differences, "rows", lambda self, x: asked.append(1) or real(self, x))
    own = frame(50, 400, 7, names)
    system.fit(own, memory)
    warm, _ = len(asked), asked.clear()
    system.fit(own)
    assert warm < len(asked) / 3


def test_teams_as_categories_equal_names():
    names = [f"t{k:03d}" for k in range(60)]
    own = frame(20, 200, 3, names)
    a, b = ratings.teams(own), ratings.teams(own.astype({"home_team": str, "away_team": str}))
    assert list(a.names) == list(b.names) and list(a.first) == list(b.first) and list(a.second) == list(b.second)
    assert list(np.array(names)[a.place]) == list(a.names) and b.place is None


def test_a_league_of_a_hundred_thousand_teams():
    """Its dense matrix would take 80 GB."""
    n, rows = 100_000, 600_000
    h, a, home, w, y, share = pairs(n, rows)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    t = ratings.Teams(np.arange(n), h, a)
    r = ratings.ridge_fit(t, home, w, np.stack([w * y, w * np.clip(y, -10, 10)], axis=1), 4.0)
    s = ratings.strength_fit(t, home, w, share)
    x = ratings.sides_fit(t, home, w, w * 28, w * 24)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000
    d = sparse.Differences(h, a, home, n)
    assert np.abs(d.sums(w * y) - d.sums(w * d.rows(r[:, 0])) - np.r_[np.full(n, 4.0), 1e-6] * r[:, 0]).max() < 1e-6
    assert np.abs(d.sums(w * (share - 1 / (1 + np.exp(-d.rows(s))))) - np.r_[np.full(n, 3.0), 0] * s).max() < 1e-6
    assert x[-2] == pytest.approx(26, abs=3) and x[-2] + x[-1] > x[-2]


def test_blade_chest_starts_from_the_last_period():
    """A warm start ends at a loss no worse than a cold one's, and new teams leave zero."""
    names = [f"t{k:03d}" for k in range(40)]
    memory = ratings.Memory()

    def loss(own, found):
        t, (blade, chest, s, edge) = ratings.teams(own), found[1:]
        x = np.concatenate([blade.ravel(), chest.ravel(), s, [edge]])
        w = own["n"].to_numpy()
        return ratings.blade_chest_loss(x, t.first, t.second, 1.0 - own["neutral_site"].to_numpy(), own["y"].to_numpy() / w, w, len(t.names), 3, 1.0)[0]

    for n, seed in ((25, 1), (40, 1), (40, 2)):
        own = frame(n, 500, seed, names)
        fit = lambda memory: ratings.blade_chest_solution(own.assign(weight=own["n"], home_win=own["y"] / own["n"]), memory=memory)
        warm, cold = fit(memory), fit(None)
        assert list(warm[0]) == list(cold[0]) and loss(own, warm) <= loss(own, cold) * 1.002
