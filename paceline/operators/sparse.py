"""Penalised least squares and logistic fits over pairs of teams, solved without a matrix: conjugate gradients on sparse designs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Residuals, as a share of the right side, at which a solution stands, and the most steps to it.
TOLERANCE, STEPS = 1e-12, 5000


def by_place(place: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``v``, or of each of its columns, by place."""
    if v.ndim == 1:
        return np.bincount(place, v, n)
    return np.stack([np.bincount(place, c, n) for c in v.T], axis=1)


@dataclass
class Differences:
    """Rows home - away + home advantage where there is one: ``n`` teams' ratings, then the advantage."""

    home: np.ndarray
    away: np.ndarray
    at_home: np.ndarray
    n: int

    @property
    def unknowns(self) -> int:
        return self.n + 1

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x[self.home] - x[self.away] + np.multiply.outer(self.at_home, x[-1])

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([by_place(self.home, v, self.n) - by_place(self.away, v, self.n), np.atleast_1d(self.at_home @ v)[None] if v.ndim > 1 else [self.at_home @ v]])

    def squares(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.home, w, self.n) + np.bincount(self.away, w, self.n), [self.at_home**2 @ w]])


@dataclass
class Sides:
    """Rows level + offence of a team - defence of the other + home bonus: ``n`` offences, ``n`` defences, level, bonus."""

    team: np.ndarray
    other: np.ndarray
    home: np.ndarray
    n: int

    @property
    def unknowns(self) -> int:
        return 2 * self.n + 2

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x[self.team] - x[self.n + self.other] + x[-2] + self.home * x[-1]

    def sums(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.team, v, self.n), -np.bincount(self.other, v, self.n), [v.sum(), self.home @ v]])

    def squares(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.team, w, self.n), np.bincount(self.other, w, self.n), [w.sum(), self.home**2 @ w]])


def solve(design: Differences | Sides, w: np.ndarray, right: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """x with (design' W design + penalties) x = right, for one right side or the columns of several at once.

    Conjugate gradients with the diagonal as preconditioner. What is held is as long as the rows or the unknowns;
    the nearer ``start`` is, the fewer the steps.
    """
    shape = (-1,) + (1,) * (right.ndim - 1)
    weight, pen = w.reshape(shape), penalty.reshape(shape)
    diag = (design.squares(w) + penalty).reshape(shape)
    times = lambda x: design.sums(weight * design.rows(x)) + pen * x
    return conjugate(times, diag, right, start)


def conjugate(times: Callable[[np.ndarray], np.ndarray], diag: np.ndarray, right: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """``solve`` for a matrix known by its products, ``times``, and its diagonal."""
    x = np.zeros_like(right) if start is None else start.astype(float).copy()
    r = right - times(x)
    goal = np.maximum(TOLERANCE**2 * (right * right / diag).sum(0), 1e-300)
    z = r / diag
    p, rz = z, (r * z).sum(0)
    for _ in range(STEPS):
        if np.all(rz <= goal):
            return x
        q = times(p)
        pq = (p * q).sum(0)
        alpha = np.divide(rz, pq, out=np.zeros_like(pq), where=pq > 0)
        x = x + alpha * p
        r = r - alpha * q
        z = r / diag
        old, rz = rz, (r * z).sum(0)
        p = z + np.divide(rz, old, out=np.zeros_like(rz), where=old > 0) * p
    raise ArithmeticError(f"no solution after {STEPS} steps")


def logistic(design: Differences, w: np.ndarray, y: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Newton's method for the weighted logistic likelihood, each step by conjugate gradients. ``y``: shares of wins.

    A step is halved while it doesn't lower the loss; the end is a step of next to nothing. A start that is worse than
    zero isn't taken.
    """
    loss = lambda z, x: (w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * x * x).sum()
    x = np.zeros(design.unknowns)
    z = design.rows(x)
    now = loss(z, x)
    if start is not None and loss(design.rows(start), start) < now:
        x, z = start.astype(float), design.rows(start)
        now = loss(z, x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        step = solve(design, w * p * (1 - p), design.sums(w * (y - p)) - penalty * x, np.maximum(penalty, 1e-12))
        if np.abs(step).max(initial=0) < 1e-10:
            break
        part = 1.0
        while True:
            new = x + part * step
            z_new = design.rows(new)
            then = loss(z_new, new)
            if then <= now + 1e-12 * abs(now) or part < 1e-6:
                break
            part /= 2
        x, z, now = new, z_new, then
    return x
