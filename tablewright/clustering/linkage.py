"""Single linkage by a minimum spanning tree, grown in Borůvka rounds on the neighbour graph.

In each round every part of the forest takes its shortest edge to another part, if its
points' lists of neighbours prove that there is no shorter one: a point all of whose listed
neighbours belong to its own part may have an unlisted one elsewhere, but not nearer than
the last of its list. Where no part can be sure any more, mostly because parts lie far
apart, the closest points of parts are found by splitting their bounding boxes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.clustering.density import _box, _gaps
from tablewright.functions.blocks import matrix
from tablewright.operators.components import connected_components
from tablewright.operators.lookup import lookup
from tablewright.operators.neighbour_graph import neighbour_edges
from tablewright.operators.ordering import with_position
from tablewright.operators.proximity import GRID_DIMENSIONS
from tablewright.runtime import bounded_count, cut

NEIGHBOURS = 8
# Up to this many parts are compared by their boxes; with more, longer lists of neighbours are made.
BOXED_PARTS = 1_000
# Splits after which single points are compared.
_POINT_LEVEL = 48
# As soon as no more pairs of points than this are open, they are compared.
_POINT_PAIRS = 2_000_000
# Most occupied cells of a grid whose parts the driver finds, and how often its sides are halved at most.
GRID_CELLS = 50_000
_GRID_LEVELS = 20


def spanning_tree(points: DataFrame, p: float = 2.0, neighbours: int = NEIGHBOURS, boxed_parts: int = BOXED_PARTS,
                  joined: DataFrame | None = None) -> DataFrame:
    """(u, v, d): the minimum spanning tree of ``points(pid, x)``, all distinct; ties go to smaller pids.

    With ``joined(pid, c)``, a few parts whose own trees are not asked for, the edges between those.
    """
    n = points.count()
    if joined is None:
        lists, k = cut(neighbour_edges(points, neighbours, p), "lists"), neighbours
        label, parts = cut(points.select("pid", F.col("pid").alias("c")), "label"), n
    else:
        lists, k, label, parts = None, n, joined, joined.select("c").distinct().count()
    tree = None
    while parts > 1:
        chosen = cut(_from_lists(lists, label, complete=k >= n - 1), "chosen") if lists is not None else None
        if chosen is None or chosen.isEmpty():
            if lists is not None and parts > boxed_parts:
                k = min(2 * k, n - 1)
                lists = cut(neighbour_edges(points, k, p), "lists")
                continue
            chosen = cut(_from_boxes(points.join(label, "pid"), p), "chosen")
        edges = chosen.select("e.u", "e.v", "e.d").distinct()
        tree = edges if tree is None else tree.union(edges)
        linked = connected_components(chosen.select(F.col("c").alias("a"), F.col("other").alias("b")))
        merged = lookup(label, linked, "c", "node", "component")
        label = cut(merged.select("pid", F.coalesce("component", "c").alias("c")), "label")
        parts = label.select("c").distinct().count()
    if tree is None:
        return points.sparkSession.createDataFrame([], "u long, v long, d double")
    return cut(tree, "tree")


def _edge() -> Column:
    return F.struct("d", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _from_lists(lists: DataFrame, label: DataFrame, complete: bool) -> DataFrame:
    """(c, e, other): the shortest edge of every part for which its lists settle it."""
    mine, theirs = label.select(F.col("pid").alias("u"), "c"), label.select(F.col("pid").alias("v"), F.col("c").alias("other"))
    near = lists.join(mine, "u").join(theirs, "v")
    out = F.min(F.when(F.col("c") != F.col("other"), F.struct(_edge().alias("e"), "other")))
    points = near.groupBy("u", "c").agg(out.alias("best"), F.max("d").alias("reach"))
    unsure = F.lit(None).cast("double") if complete else F.min(F.when(F.col("best").isNull(), F.col("reach")))
    parts = points.groupBy("c").agg(F.min("best").alias("best"), unsure.alias("unsure"))
    return parts.where("best is not null and (unsure is null or best.e.d < unsure)").select("c", "best.e", "best.other")


def _box_pairs(parts: DataFrame, width: int, p: float) -> DataFrame:
    """(c, c2): parts that may hold each other's closest points, by the boxes of a few parts."""
    rows = parts.toPandas()  # BOXED_PARTS at most
    low, high, names = matrix(rows["lo"], width), matrix(rows["hi"], width), rows["c"].to_numpy()
    sent = parts.sparkSession.sparkContext.broadcast((names, low, high))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, low, high = sent.value
        for frame in frames:
            for c, lo, hi in zip(frame["c"], frame["lo"], frame["hi"]):
                lo, hi = np.asarray(lo), np.asarray(hi)
                gap = np.linalg.norm(np.maximum(np.maximum(low - hi, lo - high), 0), ord=p, axis=1)
                far = np.linalg.norm(np.maximum(high - lo, hi - low), ord=p, axis=1)
                gap[names == c] = far[names == c] = np.inf
                keep = gap <= far.min() * (1 + 1e-12)
                yield pd.DataFrame({"c": np.full(keep.sum(), c), "c2": names[keep]})

    pairs = parts.select("c", "lo", "hi").mapInPandas(run, "c long, c2 long")
    return pairs.select(F.least("c", "c2").alias("c"), F.greatest("c", "c2").alias("c2")).distinct()


def _from_boxes(points: DataFrame, p: float) -> DataFrame:
    """(c, e, other): the shortest edge of every part of ``points(pid, x, c)``.

    Boxes are split until only pairs of single points are left; a pair of boxes whose gap is
    wider than the longest way across another pair of the same part cannot hold its edge.
    """
    width = len(points.first().x)
    points = cut(points, "points")
    parts = cut(points.groupBy("c").agg(*_box(width)), "parts")
    ends = parts.agg(*[f for j in range(width) for f in (F.min(F.col("lo")[j]), F.max(F.col("hi")[j]))]).first()
    extent = max(ends[2 * j + 1] - ends[2 * j] for j in range(width)) or 1.0
    pairs = _box_pairs(parts, width, p).withColumns({"ka": F.lit(None).cast("array<double>"), "kb": F.lit(None).cast("array<double>")})
    level, parent, live = 2, None, points
    near, reach = _gaps(p)
    while True:
        last = level >= _POINT_LEVEL
        key = F.col("x") if last else F.transform("x", lambda v: F.floor(v * F.lit(2.0**level / extent)).cast("double"))
        up = F.lit(None).cast("array<double>") if parent is None else parent
        keyed = live.withColumns({"key": key, "up": up})
        boxes = cut(keyed.groupBy("c", "key").agg(F.first("up").alias("up"), F.min("pid").alias("pid"), F.count(F.lit(1)).alias("m"), *_box(width)), "boxes")
        a = boxes.select("c", F.col("up").alias("ua"), F.col("key").alias("na"), F.col("pid").alias("pa"), F.col("m").alias("ma"), "lo", "hi")
        b = boxes.select(F.col("c").alias("c2"), F.col("up").alias("ub"), F.col("key").alias("nb"), F.col("pid").alias("pb"), F.col("m").alias("mb"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        joined = pairs.join(a, "c").where(F.col("ka").eqNullSafe(F.col("ua"))) if parent is None else pairs.join(a, (pairs["c"] == a["c"]) & (F.col("ka") == F.col("ua"))).drop(a["c"])
        joined = joined.join(b, "c2").where(F.col("kb").eqNullSafe(F.col("ub"))) if parent is None else joined.join(b, (joined["c2"] == b["c2"]) & (F.col("kb") == F.col("ub"))).drop(b["c2"])
        tested = cut(joined.select("c", "c2", "na", "nb", "pa", "pb", (F.col("ma").cast("double") * F.col("mb")).alias("ways"), near.alias("gap"), reach.alias("far")), "tested")
        both = tested.select("c", "far").union(tested.select(F.col("c2").alias("c"), "far"))
        most = cut(both.groupBy("c").agg((F.min("far") * (1 + 1e-12)).alias("most")), "most")
        kept = (tested.join(most, "c").join(most.withColumnsRenamed({"c": "c2", "most": "most2"}), "c2")
                .where("gap <= most or gap <= most2"))
        kept = cut(kept.drop("most", "most2"), "kept")
        if last or kept.where("far > gap").isEmpty():
            ways = kept.select("c", F.col("c2").alias("other"), F.col("gap").alias("d"), F.col("pa").alias("u"), F.col("pb").alias("v"))
            ways = ways.union(kept.select(F.col("c2").alias("c"), F.col("c").alias("other"), F.col("gap").alias("d"), F.col("pa").alias("u"), F.col("pb").alias("v")))
            best = ways.groupBy("c").agg(F.min(F.struct(_edge().alias("e"), "other")).alias("best"))
            return best.select("c", "best.e", "best.other")
        pairs = kept.select("c", "c2", F.col("na").alias("ka"), F.col("nb").alias("kb"))
        some = kept.select("c", F.col("na").alias("key")).union(kept.select(F.col("c2").alias("c"), F.col("nb").alias("key"))).distinct()
        live = cut(live.withColumn("key", key).join(some, ["c", "key"], "left_semi").select("pid", "x", "c"), "live")
        few = kept.agg(F.sum("ways")).first()[0] <= _POINT_PAIRS
        parent, level = key, _POINT_LEVEL if few else level + 2


def _cell_parts(cells: np.ndarray) -> np.ndarray:
    """For every cell (distinct rows of whole numbers) the number of the part it belongs to; cells that touch belong together."""
    width = cells.shape[1]
    key = lambda c: (c + 1) @ (np.int64(1) << (21 * np.arange(width, dtype=np.int64)))
    keys = key(cells)
    order = np.argsort(keys)
    ends = []
    for shift in itertools.product((-1, 0, 1), repeat=width):
        if shift > (0,) * width:
            wanted = key(cells + np.array(shift))
            at = order[np.minimum(np.searchsorted(keys, wanted, sorter=order), len(keys) - 1)]
            found = np.flatnonzero(keys[at] == wanted)
            ends.append(np.stack([found, at[found]]))
    a, b = np.concatenate(ends, axis=1)
    label = np.arange(len(cells))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


def separate_parts(points: DataFrame, least: int, p: float = 2.0, most: int = BOXED_PARTS, grid_cells: int = GRID_CELLS) -> DataFrame | None:
    """(pid, c): parts, ``least`` or a few more, that single linkage has completed before it joins any two of them; or None.

    Points that a chain of steps of at most the side of a grid's cells connects lie in
    touching cells, and points of touching cells are at most twice a cell's diagonal apart.
    So where two grids have equally many parts, the wider one's side being longer than that,
    each part hangs together by steps that are shorter than any way out of it.
    """
    width = len(points.first().x)
    if width > GRID_DIMENSIONS:
        return None
    x = F.col("x")
    ends = points.agg(*[f for j in range(width) for f in (F.min(x[j]), F.max(x[j]))]).first()
    extent = max(ends[2 * j + 1] - ends[2 * j] for j in range(width))
    if not 0 < extent < float("inf"):
        return None
    ratio = 2 * (1.0 if np.isinf(p) else width ** (1 / p)) * (1 + 1e-6)
    apart = next(j for j in range(1, 9) if 2**j >= ratio)
    scale = 2.0**_GRID_LEVELS / (extent * (1 + 1e-9))
    names = [f"c{j}" for j in range(width)]
    celled = cut(points.select("pid", *[F.floor((x[j] - F.lit(float(ends[2 * j]))) * F.lit(scale)).cast("long").alias(c) for j, c in enumerate(names)]), "celled")
    up = lambda level: [F.shiftright(c, _GRID_LEVELS - level).alias(c) for c in names]
    finest, beyond, held = 0, _GRID_LEVELS + 1, None
    while beyond - finest > 1:
        level = (finest + beyond) // 2
        seen = cut(celled.select(*up(level)).distinct(), "cells")
        if bounded_count(seen, grid_cells) <= grid_cells:
            finest, held = level, seen
        else:
            beyond = level
    if finest <= apart:
        return None
    fine = held.toPandas()[names].to_numpy(np.int64)
    parts = {}
    for level in range(1, finest + 1):
        cells, at = np.unique(fine >> (finest - level), axis=0, return_inverse=True)
        found = _cell_parts(cells)
        parts[level] = found.max() + 1, found[at.ravel()]
        if level > apart and least <= parts[level][0] <= most and parts[level][0] == parts[level - apart][0]:
            break
    else:
        return None
    rows = [(*c, int(i)) for c, i in zip(fine.tolist(), parts[level][1])]
    table = points.sparkSession.createDataFrame(rows, ", ".join(f"{c} long" for c in [*names, "part"]))
    marked = celled.select("pid", *up(finest)).join(F.broadcast(table), names).select("pid", "part")
    first = cut(marked.groupBy("part").agg(F.min("pid").alias("c")), "parts")
    return cut(marked.join(F.broadcast(first), "part").select("pid", "c"), "separate")


def single_linkage(points: DataFrame, n_clusters: int, p: float = 2.0, **options) -> DataFrame:
    """(pid, cluster) of ``points(pid, x)``: what the spanning tree leaves without its n_clusters - 1 longest edges.

    Of equally long edges those between larger pids are dropped first. Clusters are numbered
    by their smallest pid. With fewer points than clusters each point is one.
    """
    parts = separate_parts(points, n_clusters, p, min(BOXED_PARTS, 10 * n_clusters))
    own = points.select("pid", F.col("pid").alias("c")) if parts is None else parts
    if parts is not None and bounded_count(parts.select("c").distinct(), n_clusters) == n_clusters:
        labelled = parts
    else:
        tree = spanning_tree(points, p, joined=parts, **options)
        dropped = tree.orderBy(F.desc("d"), F.desc("u"), F.desc("v")).limit(max(0, n_clusters - 1)).select("u", "v")
        kept = tree.join(F.broadcast(dropped), ["u", "v"], "left_anti")
        if parts is not None:
            kept = kept.join(own.select(F.col("pid").alias("u"), F.col("c").alias("cu")), "u").join(own.select(F.col("pid").alias("v"), F.col("c").alias("cv")), "v")
            kept = kept.select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        joined = connected_components(kept.select(F.col("u").alias("a"), F.col("v").alias("b")))
        labelled = cut(lookup(own, joined, "c", "node", "component").select("pid", F.coalesce("component", "c").alias("c")), "labelled")
    names = with_position(labelled.groupBy("c").agg(F.count(F.lit(1)).alias("n")), ["c"], "cluster")
    return lookup(labelled, cut(names, "names"), "c", "c", "cluster").select("pid", F.col("cluster").cast("long").alias("cluster"))
