"""An R-tree over count vectors: which sets may overlap enough, told by how many items they have in each group."""

from __future__ import annotations

import numpy as np

from tablewright.llm import arrays as A

GROUPS = 128
LEAF = 16
FANOUT = 8
# Pairs of a point and a node (or point) that are bounded at once.
TOGETHER = 1 << 14
_SALT = np.uint64(0x94D049BB133111EB)


def count_vectors(values: np.ndarray, first: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """(sets, groups): how many items of each set hash into each group."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    group = (A.mix64(values ^ _SALT) % np.uint64(groups)).astype(np.int64)
    return np.bincount(owner * groups + group, minlength=n * groups).reshape(n, groups).astype(np.uint32)


def reaches(shared, a, b, percent: int):
    """Do ``shared`` items make sets of sizes a and b similar enough? Whole numbers on both sides."""
    return shared * (100 + percent) >= (a + b) * percent


class CountTree:
    """Points packed into nodes, each with the largest count per group and the smallest and largest set.

    Two sets share at most the sum over groups of their smaller counts, and a point shares
    with any member of a node at most the sum of smaller counts with the node's largest.
    """

    def __init__(self, points: np.ndarray, percent: int):
        self.percent = percent
        self.order = _packed(points)
        self.points = points[self.order]
        self.sizes = self.points.sum(axis=1, dtype=np.int64)
        # Levels from the leaves up: first child of each node, in points for leaves.
        self.levels = []
        starts, high, least, most = np.arange(0, len(points), LEAF), self.points, self.sizes, self.sizes
        while len(points):
            high, least, most = np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((starts, high, least, most))
            if len(starts) == 1:
                break
            starts = np.arange(0, len(starts), FANOUT)

    def _label_ranges(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, low, high = [], labels[self.order], labels[self.order]
        for starts, *_ in self.levels:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            out.append((low, high))
        return out

    def candidates(self, points: np.ndarray, own: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, member) pairs that may be similar enough and whose labels differ.

        ``own`` are the labels of ``points``, ``labels`` those of the tree's members. Nodes
        whose members all have a point's label are not entered.
        """
        sizes = points.sum(axis=1, dtype=np.int64)
        ranges = self._label_ranges(labels)
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            _, high, least, most = self.levels[level]
            low_label, high_label = ranges[level]
            keep = (low_label[node] != own[query]) | (high_label[node] != own[query])
            query, node = query[keep], node[keep]
            keep = self._may(points, sizes, query, high, least, most, node)
            query, node = query[keep], node[keep]
            step, count = (FANOUT, len(self.levels[level - 1][0])) if level else (LEAF, len(self.order))
            children = node[:, None] * step + np.arange(step)
            inside = children < count
            query, node = np.broadcast_to(query[:, None], children.shape)[inside], children[inside]
        mine = labels[self.order][node] != own[query]
        query, node = query[mine], node[mine]
        keep = self._may(points, sizes, query, self.points, self.sizes, self.sizes, node)
        return query[keep], self.order[node[keep]]

    def _may(self, points, sizes, query, high, least, most, node) -> np.ndarray:
        size = sizes[query]
        # The larger of two sets is at most 100 / percent times the smaller one.
        keep = (most[node] * 100 >= size * self.percent) & (size * 100 >= least[node] * self.percent)
        for at in range(0, len(query), TOGETHER):
            part = np.flatnonzero(keep[at: at + TOGETHER]) + at
            if len(part):
                shared = np.minimum(points[query[part]], high[node[part]]).sum(axis=1, dtype=np.int64)
                keep[part] = reaches(shared, size[part], least[node[part]], self.percent)
        return keep


def _packed(points: np.ndarray) -> np.ndarray:
    """An order that puts near points side by side: parts are halved across their widest group down to a leaf."""
    order, open_ = np.arange(len(points)), [(0, len(points))]
    while open_:
        low, high = open_.pop()
        if high - low <= LEAF:
            continue
        part = points[order[low:high]]
        sizes = part.sum(axis=1, dtype=np.int64)
        spread = part.max(axis=0).astype(np.int64) - part.min(axis=0)
        # The set size is the widest measure unless sizes are much alike.
        key = sizes if (sizes.max() - sizes.min()) > spread.max() else part[:, spread.argmax()]
        # Leaves are filled, so halves are cut at a multiple of a leaf.
        half = (high - low) // 2 // LEAF * LEAF or LEAF
        order[low:high] = order[low:high][np.argsort(key, kind="stable")]
        open_ += [(low, low + half), (low + half, high)]
    return order
