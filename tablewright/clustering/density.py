"""DBSCAN on grid cells (after Gan & Tao 2015), exact and without listing pairs.

Cells have a diameter of at most eps, so all points of a cell are neighbours: a
cell with enough points needs no distances at all. Points are compared one by one
only when they lie in sparse cells, and whether two cells connect is settled by
the bounding boxes of ever smaller parts of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.clustering.wide_density import label_points
from tablewright.functions.vectors import as_array, dot, minkowski
from tablewright.operators.components import connected_components
from tablewright.operators.lookup import lookup
from tablewright.operators.ordering import with_position
from tablewright.operators.proximity import GRID_DIMENSIONS, around, widest
from tablewright.runtime import cut

POWERS = {"euclidean": 2.0, "l2": 2.0, "manhattan": 1.0, "l1": 1.0, "cityblock": 1.0, "chebyshev": math.inf}
_EXACT_LEVEL = 40


def _norm(values: Column, p: float) -> Column:
    zeros = F.transform(values, lambda v: F.lit(0.0))
    return minkowski(values, zeros, p)


def _box(width: int) -> list[Column]:
    return [
        F.array(*[F.min(F.col("x")[j]) for j in range(width)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(width)]).alias("hi"),
    ]


def _gaps(p: float) -> tuple[Column, Column]:
    """Smallest and largest distance between boxes (lo, hi) and (lo2, hi2)."""
    ahead = F.zip_with("lo2", "hi", lambda a, b: a - b)
    behind = F.zip_with("lo", "hi2", lambda a, b: a - b)
    near = F.zip_with(ahead, behind, lambda a, b: F.greatest(a, b, F.lit(0.0)))
    reach = F.zip_with(F.zip_with("hi2", "lo", lambda a, b: a - b), F.zip_with("hi", "lo2", lambda a, b: a - b),
                       lambda a, b: F.greatest(a, b))
    return _norm(near, p), _norm(reach, p)


def dbscan(df: DataFrame, id_column: str, features, eps: float = 0.5, min_samples: int = 5,
           metric: str = "euclidean", p: float | None = None) -> DataFrame:
    """(id, cluster, core): clusters are numbered by their smallest id, noise is -1.

    A border point within reach of several clusters joins the one numbered lowest.
    """
    if metric not in ("cosine", "minkowski", *POWERS):
        raise ValueError(f"unsupported metric: {metric}")
    power = float(p) if p else POWERS.get(metric, 2.0)
    point = as_array(df, features)
    if metric == "cosine":
        norm = F.sqrt(dot(point, point))
        point, power, eps = F.transform(point, lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0))), 2.0, math.sqrt(2 * eps)
    given = df.select(F.col(id_column).alias("id"), point.alias("x"))
    width = len(given.first().x)
    if width > GRID_DIMENSIONS:
        return _wide(given, id_column, eps, min_samples, power)
    side = eps * (1 - 1e-12) / (1.0 if math.isinf(power) else width ** (1.0 / power))

    # Equal points act as one point with a weight; the grouping combines on the map side.
    cell = F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))
    distinct = given.groupBy("x").agg(F.min("id").alias("pid"), F.count(F.lit(1)).alias("w")).withColumn("cell", cell)
    named = distinct.groupBy("cell").agg(F.min("pid").alias("cid"), F.sum("w").alias("cw"), F.count(F.lit(1)).alias("n"), *_box(width))
    cells = cut(named, "cells")
    own = cells.select("cell", "n", F.struct("cid", "cw").alias("own"))
    points = cut(lookup(distinct, own, "cell", "cell", "own").select("pid", "x", "w", "own.cid", "own.cw"), "points")

    near = cut(_near_cells(cells, width, side, eps, power), "near")
    both = near.select("a", "b", "far").union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    sparse = points.where(F.col("cw") < min_samples)
    # Whole cells within reach count by weight; only partly reachable ones are opened.
    weights = cells.select(F.col("cid").alias("b"), F.col("cw").alias("bw"))
    around_sparse = sparse.select("pid", "x", F.col("cid").alias("a")).join(both, "a")
    whole = around_sparse.where(F.col("far") <= eps).join(weights, "b").select("pid", F.col("bw").alias("n"))
    opened = around_sparse.where(F.col("far") > eps).join(
        points.select(F.col("cid").alias("b"), F.col("x").alias("y"), F.col("w").alias("bw")), "b"
    ).where(minkowski(F.col("x"), F.col("y"), power) <= eps).select("pid", F.col("bw").alias("n"))
    reached = sparse.select("pid", F.col("cw").alias("n")).union(whole).union(opened).groupBy("pid").agg(F.sum("n").alias("n"))
    enough = reached.where(F.col("n") >= min_samples).select("pid", F.lit(True).alias("core"))
    marked = points.join(enough, "pid", "left").withColumn(
        "core", F.coalesce("core", F.col("cw") >= min_samples))
    marked = cut(marked, "marked")

    cores = marked.where("core")
    core_cells = cores.groupBy("cid").agg(F.min("pid").alias("first"), F.count(F.lit(1)).alias("n"))
    pairs = near.join(core_cells.select(F.col("cid").alias("a")), "a").join(core_cells.select(F.col("cid").alias("b")), "b")
    linked = _connected(cores, pairs.select("a", "b"), width, side, eps, power)
    component = connected_components(linked)
    labelled = core_cells.join(component.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    labelled = cut(labelled, "labelled")

    # Clusters are numbered by the smallest id among their core points.
    clusters = labelled.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    numbers = cut(with_position(clusters, ["first"], "cluster"), "numbers")
    cell_labels = cut(lookup(labelled, numbers, "component", "component", "cluster").select("cid", "n", "cluster"), "cells")
    core_labels = cut(lookup(cores, cell_labels, "cid", "cid", "cluster").select("pid", "cid", "x", "cluster"), "cores")

    loose = marked.where("not core").select("pid", "x", F.col("cid").alias("a"))
    reach = loose.join(both.select("a", "b"), "a").union(loose.select("a", "pid", "x", F.col("a").alias("b")))
    border = reach.join(core_labels.select(F.col("cid").alias("b"), F.col("x").alias("y"), "cluster"), "b").where(
        minkowski(F.col("x"), F.col("y"), power) <= eps).groupBy("pid").agg(F.min("cluster").alias("cluster"))
    labels = core_labels.select("pid", "cluster").union(border)
    outcome = F.struct(F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), "core").alias("outcome")
    by_point = cut(marked.select("pid", "x", "w", "core").join(labels, "pid", "left").select("x", F.col("w").alias("n"), outcome), "outcome")
    found = lookup(given, by_point, "x", "x", "outcome")
    return found.select(F.col("id").alias(id_column), "outcome.cluster", "outcome.core")


def _wide(given: DataFrame, id_column: str, eps: float, min_samples: int, power: float) -> DataFrame:
    """``dbscan`` of ``given(id, x)`` in many columns, where a grid does not help."""
    distinct = cut(given.groupBy("x").agg(F.min("id").cast("long").alias("pid"), F.count(F.lit(1)).alias("w")), "distinct")
    labels = distinct.join(label_points(distinct, eps, min_samples, power), "pid")
    outcome = cut(labels.select("x", F.col("w").alias("n"), F.struct("cluster", "core").alias("outcome")), "outcome")
    found = lookup(given, outcome, "x", "x", "outcome")
    return found.select(F.col("id").alias(id_column), "outcome.cluster", "outcome.core")


def _near_cells(cells: DataFrame, width: int, side: float, eps: float, p: float) -> DataFrame:
    """(a, b, far) for cells whose boxes come within eps; far is the largest distance between them."""
    steps = math.ceil(eps / side - 1e-9)
    dims = widest(cells.select(F.col("lo").alias("x")), "x", width)
    coarse = lambda: F.array(*[F.floor(F.col("cell")[j] / F.lit(steps)).cast("long") for j in dims])
    left = cells.select("cid", "lo", "hi", coarse().alias("key"))
    right = cells.select(F.col("cid").alias("b"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), around(coarse(), len(dims)).alias("key"))
    nearest, farthest = _gaps(p)
    joined = left.join(right, "key").where(F.col("cid") < F.col("b"))
    return joined.select(F.col("cid").alias("a"), "b", nearest.alias("gap"), farthest.alias("far")).where(F.col("gap") <= eps)


def _connected(cores: DataFrame, pairs: DataFrame, width: int, side: float, eps: float, p: float) -> DataFrame:
    """Pairs of cells that hold core points at most eps apart.

    Boxes of core points are split until each pair of parts is surely within eps
    or surely not; single points always decide, so the outcome is exact.
    """
    level, decided = 0, None
    open_ = pairs.withColumns({"ka": F.lit(None).cast("array<double>"), "kb": F.lit(None).cast("array<double>")})
    parent = None
    while True:
        if level >= _EXACT_LEVEL:
            key = F.col("x")
        else:
            key = F.transform("x", lambda v: F.floor(v * F.lit(float(2**level)) / F.lit(side)).cast("double"))
        boxes = cores.withColumn("key", key)
        up = F.lit(None).cast("array<double>") if parent is None else parent
        boxes = cut(boxes.withColumn("up", up).groupBy("cid", "key").agg(F.first("up").alias("up"), *_box(width)), "boxes")
        a = boxes.select(F.col("cid").alias("a_"), F.col("up").alias("ka_"), F.col("key").alias("na"), "lo", "hi")
        b = boxes.select(F.col("cid").alias("b_"), F.col("up").alias("kb_"), F.col("key").alias("nb"),
                         F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        joined = open_.join(a, (F.col("a") == F.col("a_")) & F.col("ka").eqNullSafe(F.col("ka_")))
        joined = joined.join(b, (F.col("b") == F.col("b_")) & F.col("kb").eqNullSafe(F.col("kb_")))
        nearest, farthest = _gaps(p)
        tested = cut(joined.select("a", "b", "na", "nb", nearest.alias("gap"), farthest.alias("far")).where(F.col("gap") <= eps), "tested")
        yes = tested.where(F.col("far") <= eps).select("a", "b").distinct()
        decided = yes if decided is None else decided.union(yes)
        rest = tested.where(F.col("far") > eps).select("a", "b", F.col("na").alias("ka"), F.col("nb").alias("kb"))
        open_ = cut(rest.join(yes, ["a", "b"], "left_anti"), "open")
        if open_.isEmpty():
            return decided
        if level >= _EXACT_LEVEL:
            raise AssertionError("single points always decide")
        parent, level = key, level + 2
