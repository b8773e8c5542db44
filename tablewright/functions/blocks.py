"""Small NumPy helpers used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd

# Largest distance block held at once (8 bytes per cell).
BLOCK_CELLS = 4_000_000


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of an array column as a matrix."""
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def distances(a: np.ndarray, b: np.ndarray, p: float = 2.0) -> np.ndarray:
    """Minkowski distances of every row of ``a`` to every row of ``b``, summed feature by feature."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = np.abs(a[:, j, None] - b[None, :, j])
        if p == 2:
            out += gap * gap
        elif p == 1:
            out += gap
        elif np.isinf(p):
            np.maximum(out, gap, out=out)
        else:
            out += gap**p
    if p == 2:
        return np.sqrt(out)
    return out if p == 1 or np.isinf(p) else out ** (1.0 / p)


def row_slices(rows: int, columns: int):
    """Slices of ``rows`` whose blocks stay below ``BLOCK_CELLS``."""
    step = max(1, BLOCK_CELLS // max(1, columns))
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def smallest(block: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of its ``k`` smallest cells, nearest first, ties by column."""
    k = min(k, block.shape[1])
    if block.shape[1] <= 4 * k:
        return np.argsort(block, axis=1, kind="stable")[:, :k]
    picked = np.sort(np.argpartition(block, k - 1, axis=1)[:, :k], axis=1)
    edge = np.take_along_axis(block, picked, axis=1).max(axis=1)
    tied = np.flatnonzero((block <= edge[:, None]).sum(axis=1) > k)
    if len(tied):
        picked[tied] = np.sort(np.argsort(block[tied], axis=1, kind="stable")[:, :k], axis=1)
    order = np.argsort(np.take_along_axis(block, picked, axis=1), axis=1, kind="stable")
    return np.take_along_axis(picked, order, axis=1)


# From this many columns on, Euclidean distances are first estimated by a matrix product.
SCREENED_WIDTH = 8


def paired_distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of row ``i`` of ``a`` to row ``j`` of ``b``, to the last bit those of ``distances``."""
    out = np.zeros(len(i))
    for c in range(a.shape[1]):
        gap = np.abs(a[i, c] - b[j, c])
        out += gap * gap
    return np.sqrt(out)


class Screen:
    """Estimates of squared distances to fixed points by a product of matrices in single precision, with their errors.

    Points are moved to their mean and divided by ``unit``; estimates are in its square. No
    estimate is further than ``slack`` of its row from the true square.
    """

    def __init__(self, b: np.ndarray):
        self.b, self.shift = b, b.mean(axis=0)
        moved = b - self.shift
        self.unit = float(np.abs(moved).max(initial=0.0)) or 1.0
        moved /= self.unit
        norm = (moved * moved).sum(axis=1)
        self.most = float(norm.max(initial=0.0))
        self.right = np.column_stack([moved, np.ones(len(b)), norm]).astype(np.float32)

    def estimate(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = (a - self.shift) / self.unit
        norm = (moved * moved).sum(axis=1)
        left = np.column_stack([-2 * moved, norm, np.ones(len(a))]).astype(np.float32)
        return left @ self.right.T, 3 * (a.shape[1] + 8) * 2.0**-24 * (norm + self.most)

    def safe(self, a: np.ndarray) -> bool:
        """Do single precision numbers hold the squares?"""
        size = float(np.abs(a - self.shift).max(initial=0.0)) / self.unit
        return np.isfinite(size) and size < 1e15 and np.isfinite(self.unit) and self.unit > 1e-140

    def nearest(self, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, distances) of the ``k`` nearest of every row, nearest first, ties by column; exact distances decide."""
        about, slack = self.estimate(a)
        n = about.shape[1]
        groups = max(k, n // 16)
        tall = n // groups
        # the k-th smallest of the minima of disjoint groups is no less than the k-th smallest of all
        least = about[:, : tall * groups].reshape(len(a), tall, groups).min(axis=1)
        edge = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * slack
        i, j = np.nonzero(about <= np.nextafter(edge.astype(np.float32), np.float32(np.inf))[:, None])
        d = paired_distances(a, i, self.b, j)
        order = np.lexsort((j, d, i))
        first = np.searchsorted(i, np.arange(len(a)))
        picked = order[(first[:, None] + np.arange(k)).ravel()]
        return j[picked].reshape(-1, k), d[picked].reshape(-1, k)

    def within(self, a: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the pairs at most ``eps`` apart; those too close to call are measured exactly."""
        about, slack = self.estimate(a)
        edge = (eps / self.unit) ** 2
        i, j = np.nonzero(about <= np.nextafter((edge * (1 + 1e-6) + slack).astype(np.float32), np.float32(np.inf))[:, None])
        open_ = np.flatnonzero(about[i, j] >= (edge * (1 - 1e-6) - slack)[i])
        keep = np.ones(len(i), bool)
        keep[open_] = paired_distances(a, i[open_], self.b, j[open_]) <= eps
        return i[keep], j[keep]


def screen(b: np.ndarray, p: float) -> Screen | None:
    """A screen for many columns, where one pays."""
    return Screen(b) if p == 2 and b.shape[1] >= SCREENED_WIDTH and len(b) else None


def product_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product, each to ten digits: squares that lose more are summed feature by feature."""
    if a.shape[1] < SCREENED_WIDTH:
        return distances(a, b)
    shift = b.mean(axis=0)
    x, y = a - shift, b - shift
    nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = np.column_stack([-2 * x, nx, np.ones(len(x))]) @ np.column_stack([y, np.ones(len(y)), ny]).T
    i, j = np.nonzero(out < (1e-4 * (nx + ny.max(initial=0.0)))[:, None])
    out[i, j] = 0.0
    np.sqrt(out, out=out)
    out[i, j] = paired_distances(a, i, b, j)
    return out
