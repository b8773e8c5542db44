"""Sums of distances from every point to every cluster, for many points of a few columns.

Points lie in blocks along a space-filling curve, and every block is a tree of boxes; above
them, blocks that follow one another share larger boxes. Seen from a box that is far enough
away for its size, the points of a cluster in a box act like weights on a fixed grid of
Chebyshev points of that box, and what they add is again fixed by its values on the grid of
the box it is seen from. Points in boxes that are near are summed pair by pair. With ``ORDER``
grid points a column and the ``APART`` demanded, sums of distances hold to nine digits or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.blocks import matrix
from tablewright.operators.ordering import with_position
from tablewright.operators.proximity import curve
from tablewright.runtime import cut

# Points of a block; with more than MOST_POINTS of them blocks and leaves grow, so that the grids sent to tasks do not.
BLOCK_POINTS = 4_096
LEAF_POINTS = 512
MOST_POINTS = 4_000_000
# Most grid cells of a block as a whole; a block with more clusters than that holds has no grid.
BLOCK_CELLS = 8_192
# Boxes that share the next larger one.
FAN = 4
# Grid points a column.
ORDER = 12
# Boxes may act by their grids from this many of their half widths on.
APART = 2.0
# Cells of a matrix of distances held at once: few enough for a processor's own memory.
HELD = 131_072

_AT = np.cos((2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER))
_COSINES = np.cos(np.outer(np.arange(ORDER), (2 * np.arange(ORDER) + 1) * np.pi / (2 * ORDER)))
_COSINES[1:] *= 2
_COSINES /= ORDER


def _grid(width: int) -> np.ndarray:
    """Grid points of the box from -1 to 1 in every column."""
    return np.stack([g.ravel() for g in np.meshgrid(*[_AT] * width, indexing="ij")], axis=1)


def _parts(t: np.ndarray) -> np.ndarray:
    """How much of a point at ``t`` falls to each grid point of one column."""
    angle = np.arccos(np.clip(t, -1.0, 1.0))
    return np.cos(angle[:, None] * np.arange(ORDER)) @ _COSINES


def _column_parts(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    half = (high - low) / 2
    return [_parts((x[:, j] - low[j] - half[j]) / half[j] if half[j] > 0 else np.zeros(len(x))) for j in range(x.shape[1])]


def _crossed(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = (out[:, :, None] * part[:, None, :]).reshape(len(out), -1)
    return out


def _weights(x: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Weights on the grid of a box that act like weighted points in it."""
    parts = _column_parts(x, low, high)
    if len(parts) == 1:
        return w @ parts[0]
    return (_crossed(parts[:-1]) * w[:, None]).T.dot(parts[-1]).ravel()


def _split(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes): rows in the order of a tree's leaves, and its nodes (start, stop, two children), parents first.

    Boxes are halved across their longest side. Rows that are in order stay so.
    """
    order, nodes, open_ = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while open_:
        start, stop, parent, side = open_.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        nodes.append([start, stop, -1, -1])
        if stop - start <= most:
            continue
        rows = order[start:stop]
        own = x[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        j = int((high - low).argmax())
        left = own[:, j] <= low[j] + (high[j] - low[j]) / 2
        if left.all() or not left.any():
            left = np.arange(len(rows)) < len(rows) // 2
        order[start:stop] = np.concatenate([rows[left], rows[~left]])
        middle, me = start + int(left.sum()), len(nodes) - 1
        open_ += [(middle, stop, me, 1), (start, middle, me, 0)]
    return order, np.array(nodes)


def _blocks(points: DataFrame, width: int, size: int, leaf: int) -> DataFrame:
    """(b, x, c, w): blocks of points that lie near each other, as bytes."""
    placed = with_position(points.select("x", "c", "w", curve(points, width)(F.col("x")).alias("curve")), ["curve", "x", "c"], "place")
    packed = placed.groupBy(F.floor(F.col("place") / size).alias("b")).agg(
        *[F.collect_list(F.col("x")[j]).alias(f"x{j}") for j in range(width)], F.collect_list("c").alias("c"), F.collect_list(F.col("w").cast("double")).alias("w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x = np.column_stack([np.asarray(getattr(row, f"x{j}"), float) for j in range(width)])
                order, _ = _split(x, leaf)
                yield pd.DataFrame({"b": [row.b], "x": [x[order].tobytes()], "c": [np.asarray(row.c, np.int64)[order].tobytes()], "w": [np.asarray(row.w, float)[order].tobytes()]})

    return packed.mapInPandas(run, "b long, x binary, c binary, w binary")


def _read(row, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.x).reshape(-1, width), np.frombuffer(row.c, np.int64), np.frombuffer(row.w)


class _Tree:
    """Boxes of all blocks and above them, and the grids of those that have fewer cells than points."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values(["b", "node"]).reset_index(drop=True)
        self.width, self.cells, self.grid = width, ORDER**width, _grid(width)
        b = rows["b"].to_numpy()
        root = np.flatnonzero(rows["node"].to_numpy() == 0)
        base = root[np.searchsorted(b[root], b)]
        low, high = list(matrix(rows["lo"], width)), list(matrix(rows["hi"], width))
        kids = [[base[i] + k for k in pair if k >= 0] for i, pair in enumerate(zip(rows["left"], rows["right"]))]
        grids = [{int(c): v for c, v in zip(cs, np.frombuffer(m).reshape(len(cs), -1))} if m is not None else None for cs, m in zip(rows["c"], rows["m"])]
        count = (rows["stop"] - rows["start"]).tolist()
        level = root.tolist()
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FAN):
                group = level[at: at + FAN]
                low.append(np.min([low[i] for i in group], axis=0))
                high.append(np.max([high[i] for i in group], axis=0))
                count.append(sum(count[i] for i in group))
                kids.append(group)
                grids.append(self._joined([(low[i], high[i], grids[i]) for i in group], low[-1], high[-1]))
                above.append(len(low) - 1)
            level = above
        self.root, self.blocks, self.first = level[0], b, dict(zip(b[root].tolist(), root.tolist()))
        self.start, self.stop = rows["start"].to_numpy(), rows["stop"].to_numpy()
        self.low, self.high = np.array(low), np.array(high)
        self.half = ((self.high - self.low) / 2).max(axis=1)
        self.kids = np.full((len(kids), FAN), -1)
        for i, own in enumerate(kids):
            self.kids[i, : len(own)] = own
        used = [g is not None and len(g) * self.cells < n for g, n in zip(grids, count)]
        self.used = np.array(used)
        listed = sorted((c, i) for i, g in enumerate(grids) if used[i] for c in g)
        self.codes, self.nodes = (np.array([e[j] for e in listed], np.int64) for j in (0, 1))
        self.weights = np.array([grids[i][c] for c, i in listed]).reshape(len(listed), self.cells)

    def _joined(self, parts: list, low: np.ndarray, high: np.ndarray) -> dict | None:
        if any(g is None for _, _, g in parts):
            return None
        out: dict[int, np.ndarray] = {}
        for lo, hi, grids in parts:
            at = (lo + hi) / 2 + (hi - lo) / 2 * self.grid
            for c, w in grids.items():
                out[c] = out.get(c, 0.0) + _weights(at, w, low, high)
        return out

    def seen(self, low: np.ndarray, high: np.ndarray, own_half: float) -> tuple[np.ndarray, np.ndarray]:
        """Boxes that act by their grids on a box, and leaves that are met point by point."""
        far, near, open_ = [], [], np.array([self.root])
        while len(open_):
            gap = np.maximum(np.maximum(self.low[open_] - high, low - self.high[open_]), 0)
            apart = np.sqrt((gap * gap).sum(axis=1))
            # a box without width seen from one without width: only if apart at all
            grid = self.used[open_] & (apart > 0) & (apart >= APART * self.half[open_]) & (apart >= APART * own_half)
            far.append(open_[grid])
            rest = open_[~grid]
            leaf = self.kids[rest, 0] < 0
            near.append(rest[leaf])
            open_ = self.kids[rest[~leaf]].ravel()
            open_ = open_[open_ >= 0]
        return np.concatenate(far), np.concatenate(near)

    def grid_sums(self, at: np.ndarray, far: np.ndarray, clusters: int) -> np.ndarray:
        """Sums of distances of ``at`` to what lies in far boxes, by cluster."""
        out = np.zeros((len(at), clusters))
        mine = np.zeros(len(self.low), bool)
        mine[far] = True
        entries = np.flatnonzero(mine[self.nodes])
        centre = (at.min(axis=0) + at.max(axis=0)) / 2
        a = at - centre
        left = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a))])
        step = max(1, HELD // (len(at) * self.cells))
        for group in np.split(entries, np.flatnonzero(np.diff(self.codes[entries])) + 1):
            for i in range(0, len(group), step):
                some = group[i: i + step]
                low, high = self.low[self.nodes[some]], self.high[self.nodes[some]]
                y = (((low + high) / 2 - centre)[:, None, :] + ((high - low) / 2)[:, None, :] * self.grid).reshape(-1, self.width)
                d = left @ np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1)]).T
                np.sqrt(d, out=d)
                out[:, self.codes[some[0]]] += d @ self.weights[some].ravel()
        return out


def _pair_sums(x: np.ndarray, y: np.ndarray, code: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
    """Add the distances of ``x`` to ``y``, pair by pair, by the code of ``y``."""
    order = np.argsort(code, kind="stable")
    y, code, w = y[order], code[order], w[order]
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
    step = max(1, HELD // len(y))
    for i in range(0, len(x), step):
        own = x[i: i + step]
        d = own[:, 0, None] - y[None, :, 0]
        d *= d
        for j in range(1, x.shape[1]):
            gap = own[:, j, None] - y[None, :, j]
            gap *= gap
            d += gap
        np.sqrt(d, out=d)
        for a, b in zip(edges, edges[1:]):
            out[i: i + step, code[a]] += d[:, a:b] @ w[a:b]


class _Own:
    """A block whose sums are being formed."""

    def __init__(self, row, tree: _Tree, leaf: int, names: np.ndarray):
        self.x, self.c, self.w = _read(row, tree.width)
        self.tree, self.names = tree, names
        self.sums = np.zeros((len(self.x), len(names)))
        self.near: dict[int, list] = {}
        for part, far, near in _views(self.x, tree, leaf):
            own = self.x[part]
            if len(own) > tree.cells:
                low, high = own.min(axis=0), own.max(axis=0)
                held = tree.grid_sums((low + high) / 2 + (high - low) / 2 * tree.grid, far, len(names))
                self.sums[part] += _crossed(_column_parts(own, low, high)) @ held
            else:
                self.sums[part] += tree.grid_sums(own, far, len(names))
            for b in np.unique(tree.blocks[near]).tolist():
                self.near.setdefault(b, []).append((part, near[tree.blocks[near] == b]))

    def meet(self, row) -> None:
        x, c, w = _read(row, self.tree.width)
        code = np.searchsorted(self.names, c)
        for part, near in self.near.get(row.b, ()):
            at = np.concatenate([np.arange(self.tree.start[i], self.tree.stop[i]) for i in near])
            _pair_sums(self.x[part], x[at], code[at], w[at], self.sums[part])

    def done(self, size: np.ndarray) -> pd.DataFrame:
        mine, at = np.searchsorted(self.names, self.c), np.arange(len(self.x))
        own = self.sums[at, mine] / np.maximum(size[mine] - 1, 1)
        means = self.sums / size
        means[at, mine] = np.inf
        other = means.min(axis=1)
        value = np.where(size[mine] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
        return pd.DataFrame({"s": [float(value @ self.w)], "w": [float(self.w.sum())]})


def _views(x: np.ndarray, tree: _Tree, leaf: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For every leaf of a block its rows, the boxes that act on it by their grids and the leaves it meets."""
    for start, stop, left, _ in _split(x, leaf)[1]:
        if left < 0:
            own = x[start:stop]
            low, high = own.min(axis=0), own.max(axis=0)
            by_grid = len(own) > tree.cells
            yield slice(start, stop), *tree.seen(low, high, float((high - low).max() / 2) if by_grid else 0.0)


def mean_score(points: DataFrame, sizes: dict[int, int], n: int, width: int, block_points: int = BLOCK_POINTS, leaf_points: int = LEAF_POINTS) -> float:
    """Mean silhouette of ``n`` distinct points (x, c, w) in clusters of the given sizes."""
    grown = math.ceil(n / MOST_POINTS)
    size, leaf, cells = block_points * grown, leaf_points * grown, ORDER**width
    blocks = cut(_blocks(points, width, size, leaf), "blocks")
    names = np.array(sorted(sizes))
    counts = np.array([sizes[c] for c in names.tolist()], float)

    def boxes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                x, c, w = _read(row, width)
                code = np.searchsorted(names, c)
                nodes = _split(x, leaf)[1]
                out = {"lo": [], "hi": [], "c": [], "m": []}
                for i, (start, stop, _, _) in enumerate(nodes):
                    own, kind = x[start:stop], code[start:stop]
                    low, high, held = own.min(axis=0), own.max(axis=0), np.unique(kind)
                    room = len(held) * cells < stop - start or i == 0 and len(held) * cells <= BLOCK_CELLS
                    out["lo"].append(low)
                    out["hi"].append(high)
                    out["c"].append(held if room else [])
                    out["m"].append(np.array([_weights(own[kind == k], w[start:stop][kind == k], low, high) for k in held]).tobytes() if room else None)
                yield pd.DataFrame({"b": row.b, "node": np.arange(len(nodes)), "start": nodes[:, 0], "stop": nodes[:, 1], "left": nodes[:, 2], "right": nodes[:, 3], **out})

    # a grid has fewer cells than its points, or BLOCK_CELLS for each of at most MOST_POINTS / BLOCK_POINTS blocks
    rows = blocks.mapInPandas(boxes, "b long, node int, start int, stop int, left int, right int, lo array<double>, hi array<double>, c array<long>, m binary").toPandas()
    sent = points.sparkSession.sparkContext.broadcast(_Tree(rows, width))

    def meeting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = sent.value
        for frame in frames:
            for row in frame.itertuples():
                met = [tree.blocks[near] for _, _, near in _views(_read(row, width)[0], tree, leaf)]
                yield pd.DataFrame({"a": row.b, "b": np.unique(np.concatenate([*met, [row.b]]))})

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for frame in frames:
            for row in frame.itertuples():
                if row.a == row.b:
                    if own is not None:
                        yield own.done(counts)
                    own = _Own(row, sent.value, leaf, names)
                own.meet(row)
        if own is not None:
            yield own.done(counts)

    pairs = cut(blocks.mapInPandas(meeting, "a long, b long"), "pairs")
    shares = max(1, min(math.ceil(n / size), 512))
    # A block comes first, then those it meets.
    stream = pairs.join(blocks, "b").select("a", "b", "x", "c", "w").repartition(shares, "a").sortWithinPartitions("a", F.col("a") != F.col("b"))
    return stream.mapInPandas(summed, "s double, w double").agg(F.sum("s") / F.sum("w")).first()[0]
