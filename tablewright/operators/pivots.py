"""A two-level tree of pivots: cells of bounded size, and which of them a ball around a point can reach."""

from __future__ import annotations

import math

import numpy as np

from tablewright.functions.blocks import distances, row_slices

_SLACK = 1 + 1e-9


class PivotTree:
    """Pivots as leaves under a square root of their number as tops.

    A point belongs to the leaf of its nearest pivot, found exactly: tops whose ball lies
    further than the best pivot so far are passed by. Once ``measured``, a leaf knows how far
    its members reach, and a top how far its leaves do.
    """

    def __init__(self, pivots: np.ndarray, p: float = 2.0, seed: int = 5):
        pivots = np.unique(pivots, axis=0)
        tops = max(1, math.isqrt(len(pivots)))
        self.p = p
        self.tops = pivots[np.random.default_rng(seed).choice(len(pivots), tops, replace=False)]
        owner = distances(pivots, self.tops, p).argmin(axis=1)
        order = np.argsort(owner, kind="stable")
        self.leaves = pivots[order]
        self.first = np.searchsorted(owner[order], np.arange(tops + 1))
        to_top = distances(self.leaves, self.tops, p)[np.arange(len(order)), owner[order]]
        self.spread = np.array([to_top[a:b].max(initial=0.0) for a, b in zip(self.first[:-1], self.first[1:])])
        self.radius = np.full(len(self.leaves), np.inf)
        self.reach = np.full(tops, np.inf)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest leaf of every point and the distance to it."""
        best, leaf = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
        to_tops = distances(x, self.tops, self.p)
        home = to_tops.argmin(axis=1)
        for away in (False, True):
            for t, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
                some = np.flatnonzero((home != t) & (to_tops[:, t] - self.spread[t] <= best * _SLACK)) if away else np.flatnonzero(home == t)
                if len(some) and b > a:
                    d = distances(x[some], self.leaves[a:b], self.p)
                    at = d.argmin(axis=1)
                    near = d[np.arange(len(some)), at]
                    closer = (near < best[some]) | ((near == best[some]) & (a + at < leaf[some]))
                    best[some[closer]], leaf[some[closer]] = near[closer], a + at[closer]
        return leaf, best

    def measured(self, radius: dict[int, float], counts: dict[int, int] | None = None) -> "PivotTree":
        """Take note of how far the members of each leaf lie from it, and how many they are; leaves without members reach nowhere."""
        self.counts = np.array([(counts or {}).get(i, 0) for i in range(len(self.leaves))])
        self.radius = np.array([radius.get(i, -np.inf) for i in range(len(self.leaves))])
        self.reach = np.array([(self.radius[a:b]).max(initial=-np.inf) for a, b in zip(self.first[:-1], self.first[1:])])
        return self

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every point has ``k`` members, by whole leaves; infinite if there are fewer."""
        out = np.full(len(x), np.inf)
        for part in row_slices(len(x), len(self.leaves)):
            most = distances(x[part], self.leaves, self.p) + self.radius
            most[:, self.counts == 0] = np.inf
            order = np.argsort(most, axis=1)
            held = np.cumsum(self.counts[order], axis=1)
            enough = held[:, -1] >= k
            at = (held >= k).argmax(axis=1)
            out[part] = np.where(enough, np.take_along_axis(most, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0], np.inf)
        return out

    def reached(self, x: np.ndarray, ball: np.ndarray, leaf: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf): leaves other than its own that may hold a member within ``ball`` of a point.

        ``leaf`` and ``home`` are what ``assign`` found. A member lies on its leaf's side of
        the plane between that and the point's own leaf (with p = 2).
        """
        rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        to_tops = distances(x, self.tops, self.p)
        for t, (a, b) in enumerate(zip(self.first[:-1], self.first[1:])):
            some = np.flatnonzero(to_tops[:, t] - self.spread[t] - self.reach[t] <= ball * _SLACK)
            if not len(some) or b == a:
                continue
            d = distances(x[some], self.leaves[a:b], self.p)
            keep = d - self.radius[a:b] <= (ball[some] * _SLACK)[:, None] + 1e-12
            if self.p == 2:
                gap = distances(self.leaves[leaf[some]], self.leaves[a:b])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (d**2 - home[some, None] ** 2) / (2 * gap), 0.0)
                keep &= plane <= (ball[some] * _SLACK)[:, None] + 1e-9 * (1 + home[some, None])
            keep &= leaf[some, None] != np.arange(a, b)
            row, at = np.nonzero(keep)
            rows.append(some[row])
            found.append(a + at)
        return np.concatenate(rows), np.concatenate(found)
