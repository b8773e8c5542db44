"""The bandwidth of mean shift: the mean distance of all points to their k-th nearest, for a large k.

The k nearest of a point are a share of all points, so they are not listed. The distance to
the k-th is guessed from the means of small groups of points, and a narrow bracket around the
guess is put to the test: points lie in blocks that follow a space-filling curve, and every
round counts, per point, the weight below its bracket and in it. A bracket that turns out not
to hold the k-th moves and widens; one that does is settled by the distances in it, or, if these
are too many, goes on with the part of it that holds the k-th. Only groups that a bracket's
shell passes through are measured, one block after the other: a task holds a block, its
counts and the block it is compared with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.blocks import distances, matrix
from tablewright.operators.ordering import with_position
from tablewright.operators.proximity import curve
from tablewright.runtime import cut

BLOCK_POINTS = 4_096
# Most blocks, whose boxes are sent to every task; with more points blocks grow.
MOST_BLOCKS = 20_000
# Points of a group within a block.
LEAF_POINTS = 64
# Most groups whose means are sent to every task for the first guess.
MEANS = 16_384
# Most distances within the brackets of a block that are kept; more are only counted.
KEPT = 2_000_000
# Parts of a bracket that a round tells apart.
PARTS = 1_024
# A bracket this narrow, as a share of the widest distance, is a number.
NARROW = 1e-12


def _grouped(x: np.ndarray) -> np.ndarray:
    """An order of rows in which every ``LEAF_POINTS`` of them lie near each other."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF_POINTS:
            out.append(rows)
            continue
        at = -(-len(rows) // (2 * LEAF_POINTS)) * LEAF_POINTS
        own = x[rows]
        order = np.argsort(own[:, np.ptp(own, axis=0).argmax()], kind="stable")
        open_ += [rows[order[at:]], rows[order[:at]]]
    return np.concatenate(out)


def _blocks(points: DataFrame, size: int) -> DataFrame:
    """(b, x, w): blocks of ``size`` points that lie near each other, as bytes."""
    width = len(points.first().x)
    placed = with_position(points.select("x", "w", curve(points, width)("x").alias("curve")), ["curve", "x"], "place")
    packed = placed.groupBy(F.floor(F.col("place") / size).alias("b")).agg(F.collect_list(F.col("x")).alias("x"), F.collect_list(F.col("w").cast("double")).alias("w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = [np.array(list(map(np.asarray, rows)), float) for rows in frame["x"]]
            orders = [_grouped(rows) for rows in x]
            yield pd.DataFrame({"b": frame["b"], "x": [rows[o].tobytes() for rows, o in zip(x, orders)], "w": [np.asarray(w, float)[o].tobytes() for w, o in zip(frame["w"], orders)],
                                "lo": [rows.min(axis=0) for rows in x], "hi": [rows.max(axis=0) for rows in x], "weight": [float(np.sum(w)) for w in frame["w"]]})

    return cut(packed.mapInPandas(run, "b long, x binary, w binary, lo array<double>, hi array<double>, weight double"), "blocks")


class _Boxes:
    def __init__(self, rows: pd.DataFrame):
        self.names, self.weight = rows["b"].to_numpy(), rows["weight"].to_numpy()
        self.low, self.high = np.stack(rows["lo"].to_numpy()), np.stack(rows["hi"].to_numpy())

    def ways(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortest and longest way from a box to each box."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0)
        far = np.maximum(self.high - low, high - self.low)
        return np.sqrt((gap * gap).sum(axis=1)), np.sqrt((far * far).sum(axis=1))


class _Leaves:
    """Boxes and weights of the groups of a block."""

    def __init__(self, x: np.ndarray, w: np.ndarray):
        self.x, self.w = x, w
        self.starts = np.arange(0, len(x), LEAF_POINTS)
        self.low, self.high = np.minimum.reduceat(x, self.starts, axis=0), np.maximum.reduceat(x, self.starts, axis=0)
        self.weight = np.add.reduceat(w, self.starts)

    def rows(self, some: np.ndarray) -> np.ndarray:
        at = (self.starts[some][:, None] + np.arange(LEAF_POINTS)).ravel()
        return at[at < len(self.x)]

    def ways(self, other: "_Leaves") -> tuple[np.ndarray, np.ndarray]:
        """Shortest and longest ways from every group to every group of another block."""
        near = far = 0.0
        for j in range(self.x.shape[1]):
            ahead, behind = other.low[None, :, j] - self.high[:, None, j], self.low[:, None, j] - other.high[None, :, j]
            near = near + np.maximum(np.maximum(ahead, behind), 0) ** 2
            far = far + np.maximum(other.high[None, :, j] - self.low[:, None, j], self.high[:, None, j] - other.low[None, :, j]) ** 2
        return np.sqrt(near), np.sqrt(far)


def _guesses(x: np.ndarray, means: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """About how far the k-th nearest of each point is, by the means of groups, and how wide a bracket to try."""
    guess, width = np.empty(len(x)), np.empty(len(x))
    for start in range(0, len(x), LEAF_POINTS):
        own = x[start: start + LEAF_POINTS]
        centre = own.mean(axis=0)
        d = distances(centre[None], means)[0]
        order = np.argsort(d)
        at = min(len(order) - 1, int(np.searchsorted(np.cumsum(weight[order]), k)))
        shell = order[max(0, at - 64): at + 64]
        away = (centre - means[shell]) / np.maximum(d[shell], 1e-300)[:, None]
        guess[start: start + LEAF_POINTS] = d[order[at]] + (own - centre) @ np.average(away, axis=0, weights=weight[shell])
        width[start: start + LEAF_POINTS] = 0.25 * np.linalg.norm(np.ptp(own, axis=0)) or 1e-3 * d[order[at]]
    return guess, width


class _Own:
    """A block, the brackets of its points and what has been counted for them."""

    def __init__(self, row, k: int, parts: int):
        self.row, self.k, self.parts = row, k, parts
        self.r0, self.r1, self.below = (np.array(v, float) for v in (row.r0, row.r1, row.below))
        self.leaves = _Leaves(np.frombuffer(row.x).reshape(len(self.r0), -1), np.frombuffer(row.w))
        self.open = self.r1 > self.r0
        self.asked = self.open & np.isnan(self.below)
        self.counted = np.where(self.asked, row.within, 0.0)
        self.kept, self.size, self.cells = [], 0, None
        self.groups = []
        for i, start in enumerate(self.leaves.starts):
            rows = start + np.flatnonzero(self.open[start: start + LEAF_POINTS])
            if len(rows):
                self.groups.append((i, rows, self.r0[rows].min(), self.r1[rows].max(), bool(self.asked[rows].any())))

    def meet(self, other: _Leaves) -> None:
        near, far = self.leaves.ways(other)
        for i, rows, low, high, asked in self.groups:
            inside = far[i] * (1 + 1e-12) < low
            if asked:
                self.counted[rows] += other.weight[inside].sum()
            some = np.flatnonzero(~inside & (near[i] * (1 - 1e-12) <= high))
            if not len(some):
                continue
            at = other.rows(some)
            d, w = distances(self.leaves.x[rows], other.x[at]), other.w[at]
            from_low = d >= self.r0[rows, None]
            if asked:
                self.counted[rows] += w.sum() - from_low @ w
            a, b = np.nonzero(from_low & (d < self.r1[rows, None]))
            self.kept.append((rows[a], d[a, b], w[b]))
            self.size += len(a)
            if self.size > KEPT:
                self._count()

    def _count(self) -> None:
        """Turn kept distances into weights of equal parts of the brackets."""
        if self.cells is None:
            self.cells = np.zeros(len(self.r0) * self.parts)
        if self.kept:
            row, d, w = (np.concatenate(c) for c in zip(*self.kept))
            step = (self.r1[row] - self.r0[row]) / self.parts
            at = np.clip(np.floor((d - self.r0[row]) / step), 0, self.parts - 1)
            at -= d < self.r0[row] + at * step
            at += d >= self.r0[row] + (at + 1) * step
            self.cells += np.bincount(row * self.parts + np.clip(at, 0, self.parts - 1).astype(np.int64), w, minlength=len(self.cells))
        self.kept, self.size = [], 0

    def done(self) -> pd.DataFrame:
        """The block with the brackets of the next round; a bracket without width is the distance."""
        below = np.where(self.asked, self.counted, self.below)
        r0, r1, out = self.r0.copy(), self.r1.copy(), self.below.copy()
        wide, most = self.r1 - self.r0, below.copy()
        enough = self.k - 1e-9
        if self.cells is None and self.kept:
            row, d, w = (np.concatenate(c) for c in zip(*self.kept))
            order = np.lexsort((d, row))
            row, d, w = row[order], d[order], w[order]
            first = np.searchsorted(row, np.arange(len(r0)))
            sums = np.concatenate([[0.0], np.cumsum(w)])
            held = below[row] + sums[1:] - sums[first[row]]
            last = np.searchsorted(row, np.arange(len(r0)), side="right")
            most = below + sums[last] - sums[first]
            hit = np.flatnonzero(held >= enough)
            rows, at = np.unique(row[hit], return_index=True)
            settled = np.zeros(len(r0), bool)
            settled[rows] = True
            settled &= self.open & (below < enough)
            value = np.zeros(len(r0))
            value[rows] = d[hit[at]]
            r0[settled] = r1[settled] = value[settled]
        else:
            settled = np.zeros(len(r0), bool)
            if self.cells is not None:
                self._count()
                sums = below[:, None] + np.cumsum(self.cells.reshape(len(r0), -1), axis=1)
                most = sums[:, -1]
                settled = self.open & (below < enough) & (most >= enough)
                at = np.minimum((sums < enough).sum(axis=1), self.parts - 1)
                step = wide / self.parts
                before = np.where(at > 0, sums[np.arange(len(at)), np.maximum(at - 1, 0)], below)
                r0[settled] = (self.r0 + at * step)[settled]
                r1[settled] = np.where(at == self.parts - 1, self.r1, self.r0 + (at + 1) * step)[settled]
                out[settled] = before[settled]
        down, up = self.open & (below >= enough), self.open & (below < enough) & ~settled
        r0[down], r1[down], out[down] = np.maximum(self.r0 - 4 * wide, 0)[down], self.r0[down], np.nan
        r0[up], r1[up], out[up] = self.r1[up], (self.r1 + 4 * wide)[up], most[up]
        row = self.row
        return pd.DataFrame({"b": [row.a], "x": [row.x], "w": [row.w], "lo": [row.lo], "hi": [row.hi], "weight": [row.weight], "r0": [r0], "r1": [r1], "below": [out]})


def estimate_bandwidth(points: DataFrame, quantile: float = 0.3, chunk_points: int = BLOCK_POINTS, parts: int = PARTS) -> float:
    """Mean distance of every row to its neighbour at the given quantile of all rows, itself counted.

    ``points`` are (x, w), a point of weight w being w rows. The result is that of sorting
    all distances of every point, to ``NARROW`` of the widest.
    """
    n, rows = points.agg(F.count(F.lit(1)), F.sum("w")).first()
    k = max(1, int(rows * quantile))
    blocks = _blocks(points, max(chunk_points, math.ceil(n / MOST_BLOCKS)))
    boxes = _Boxes(blocks.select("b", "lo", "hi", "weight").toPandas())
    sent = points.sparkSession.sparkContext.broadcast(boxes)
    group = math.ceil(n / MEANS)

    def averaged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x, w in zip(frame["x"], frame["w"]):
                w = np.frombuffer(w)
                starts = np.arange(0, len(w), group)
                weight = np.add.reduceat(w, starts)
                mean = np.add.reduceat(np.frombuffer(x).reshape(len(w), -1) * w[:, None], starts, axis=0) / weight[:, None]
                yield pd.DataFrame({"m": list(mean), "weight": weight})

    # MEANS rows, and one more for every block at most
    table = blocks.mapInPandas(averaged, "m array<double>, weight double").toPandas()
    marks = points.sparkSession.sparkContext.broadcast((matrix(table["m"], 1), table["weight"].to_numpy()))
    widest_way = max(float(boxes.ways(boxes.low.min(axis=0), boxes.high.max(axis=0))[1].max()), 1e-300)
    state_of = "b long, x binary, w binary, lo array<double>, hi array<double>, weight double, r0 array<double>, r1 array<double>, below array<double>"

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.copy()
            tried = [_guesses(np.frombuffer(x).reshape(len(w) // 8, -1), *marks.value, k) for x, w in zip(frame["x"], frame["w"])]
            wide = [np.maximum(width, 100 * NARROW * widest_way) for _, width in tried]
            out["r0"] = [np.maximum(guess - width, 0) for (guess, _), width in zip(tried, wide)]
            out["r1"] = [np.maximum(guess, 0) + width for (guess, _), width in zip(tried, wide)]
            out["below"] = [np.full(len(guess), np.nan) for guess, _ in tried]
            yield out

    def meeting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks that a shell of a block's points may pass through, and the weight of those wholly within."""
        for frame in frames:
            for a, lo, hi, r0, r1 in zip(frame["b"], frame["lo"], frame["hi"], frame["r0"], frame["r1"]):
                r0, r1 = np.asarray(r0), np.asarray(r1)
                open_ = r1 > r0
                if open_.any():
                    gap, far = sent.value.ways(np.asarray(lo), np.asarray(hi))
                    inside = far * (1 + 1e-12) < r0[open_].min()
                    keep = ~inside & (gap * (1 - 1e-12) <= r1[open_].max())
                    yield pd.DataFrame({"a": a, "b": np.append(sent.value.names[keep], -1), "within": float(sent.value.weight[inside].sum())})

    def tested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for frame in frames:
            for row in frame.itertuples():
                if row.r0 is not None:
                    if own is not None:
                        yield own.done()
                    own = _Own(row, k, parts)
                else:
                    own.meet(_Leaves(np.frombuffer(row.x).reshape(len(row.w) // 8, -1), np.frombuffer(row.w)))
        if own is not None:
            yield own.done()

    state = cut(blocks.mapInPandas(begin, state_of), "state")
    reach = lambda s: s.agg(F.max(F.array_max(F.zip_with("r1", "r0", lambda a, b: a - b)))).first()[0]
    shares = max(1, min(len(boxes.names), 512))
    while reach(state) > NARROW * widest_way:
        pairs = cut(state.mapInPandas(meeting, "a long, b long, within double"), "pairs")
        own = state.join(pairs.where("b < 0").select(F.col("a").alias("b"), "within"), "b", "left")
        own = own.select(F.col("b").alias("a"), "x", "w", "lo", "hi", "weight", "r0", "r1", "below", F.coalesce("within", F.lit(0.0)).alias("within"))
        nothing = {c: F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("lo", "hi", "weight", "r0", "r1", "below", "within")}
        others = pairs.select("a", "b").join(blocks.select("b", "x", "w"), "b").select("a", "x", "w", *nothing.values())
        # A block comes first, then those it meets.
        stream = own.union(others).repartition(shares, "a").sortWithinPartitions("a", F.col("r0").isNull())
        state = cut(stream.mapInPandas(tested, state_of), "state")

    def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"t": [float(((np.asarray(a) + np.asarray(b)) / 2) @ np.frombuffer(w)) for a, b, w in zip(frame["r0"], frame["r1"], frame["w"])]})

    return state.select("r0", "r1", "w").mapInPandas(totals, "t double").agg(F.sum("t")).first()[0] / rows
