"""The loss of Blade-Chest against its plain form, and what an evaluation costs next to that."""

import time

import numpy as np
import pytest

from paceline.operators import ratings, sparse


def plain(x, h, a, ind, y, w, n, dim, reg):
    b, c, s = x[: n * dim].reshape(n, dim), x[n * dim : 2 * n * dim].reshape(n, dim), x[2 * n * dim : -1]
    z = (b[h] * c[a]).sum(1) - (b[a] * c[h]).sum(1) + s[h] - s[a] + x[-1] * ind
    r = w * (1 / (1 + np.exp(-z)) - y)
    gb = sparse.by_place(h, r[:, None] * c[a], n) - sparse.by_place(a, r[:, None] * c[h], n)
    gc = sparse.by_place(a, r[:, None] * b[h], n) - sparse.by_place(h, r[:, None] * b[a], n)
    gs = np.bincount(h, r, n) - np.bincount(a, r, n)
    loss = (w * (np.logaddexp(0, z) - y * z)).sum() + reg / 2 * (x[:-1] ** 2).sum()
    return loss, np.concatenate([gb.ravel() + reg * b.ravel(), gc.ravel() + reg * c.ravel(), gs + reg * s, [(r * ind).sum()]])


def drawn(m, n, dim=3, size=0.5):
    rng = np.random.default_rng(3)
    h = rng.integers(0, n, m)
    a = (h + rng.integers(1, n, m)) % n
    x = size * rng.standard_normal(2 * n * dim + n + 1)
    return x, (h, a, (rng.random(m) < 0.7).astype(float), rng.random(m), rng.random(m), n, dim, 1.0)


@pytest.mark.parametrize("size", [0.5, 20.0])
def test_loss_and_gradient(size):
    x, args = drawn(20_000, 20, size=size)
    got, want = ratings.blade_chest_loss(x, *args), plain(x, *args)
    assert got[0] == pytest.approx(want[0], rel=1e-12) and got[1] == pytest.approx(want[1], rel=1e-9, abs=1e-9)


def test_an_evaluation_costs_a_part_of_the_plain_form():
    x, args = drawn(120_000, 1000)

    def least(f):
        times = []
        for _ in range(7):
            t = time.process_time()
            f(x, *args)
            times.append(time.process_time() - t)
        return min(times[1:])

    assert least(ratings.blade_chest_loss) < 0.6 * least(plain)  # it was that form
