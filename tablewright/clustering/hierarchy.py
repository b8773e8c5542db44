"""Agglomerative clustering and BIRCH over a bounded number of summaries."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tablewright.clustering.centres import assign
from tablewright.clustering.density import dbscan
from tablewright.clustering.linkage import single_linkage
from tablewright.functions.blocks import distances, matrix
from tablewright.functions.vectors import as_array
from tablewright.operators.lookup import lookup
from tablewright.operators.ordering import with_position
from tablewright.operators.proximity import grid_key
from tablewright.runtime import bounded_count, cut

# Most summaries the driver merges: their distances take 32 MB.
SUMMARIES = 2_000


def merge_tree(points: np.ndarray, sizes: np.ndarray, linkage: str, p: float = 2.0) -> list[tuple[float, int, int]]:
    """Merges (height, a, b) of a few thousand summaries by nearest-neighbour chains."""
    d = distances(points, points, p)
    n = len(points)
    size = sizes.astype(float).copy()
    if linkage == "ward":
        d *= np.sqrt(2 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(d, np.inf)
    alive, chain, merges = np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        top = chain[-1]
        other = int(d[top].argmin())
        if len(chain) > 1 and d[top, chain[-2]] <= d[top, other]:
            other = chain[-2]
        if len(chain) < 2 or other != chain[-2]:
            chain.append(other)
            continue
        chain = chain[:-2]
        a, b = min(top, other), max(top, other)
        height, na, nb = d[a, b], size[a], size[b]
        merges.append((float(height), a, b))
        rest = alive.copy()
        rest[[a, b]] = False
        da, db, ns = d[a, rest], d[b, rest], size[rest]
        if linkage == "ward":
            new = np.sqrt(np.maximum(((na + ns) * da**2 + (nb + ns) * db**2 - ns * height**2) / (na + nb + ns), 0))
        elif linkage == "average":
            new = (na * da + nb * db) / (na + nb)
        elif linkage == "complete":
            new = np.maximum(da, db)
        else:
            new = np.minimum(da, db)
        d[a, rest] = d[rest, a] = new
        d[b, :] = d[:, b] = np.inf
        size[a], alive[b] = na + nb, False
    return merges


def cut_tree(n: int, merges, n_clusters: int | None, threshold: float | None) -> np.ndarray:
    """Labels after the lowest merges: down to ``n_clusters`` or below ``threshold``."""
    group = np.arange(n)

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    # equal heights keep their order of formation
    ordered = sorted(merges, key=lambda m: m[0])
    kept = [m for m in ordered if m[0] < threshold] if threshold is not None else ordered[: max(0, n - n_clusters)]
    for _, a, b in kept:
        ra, rb = root(a), root(b)
        group[max(ra, rb)] = min(ra, rb)
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def _summaries(points: DataFrame, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points with their weights, or that many weighted centroids when there are more."""
    if bounded_count(points, most) <= most:
        rows = points.toPandas()
        return matrix(rows["x"], 1), rows["w"].to_numpy()
    vectors = points.select(array_to_vector("x").alias("features"), F.col("w").cast("double").alias("w"))
    model = KMeans(k=most, seed=seed, maxIter=5, initSteps=1, weightCol="w").fit(vectors)
    sizes = {r.prediction: r.n for r in model.transform(vectors).groupBy("prediction").agg(F.sum("w").alias("n")).collect()}
    centres = np.array(model.clusterCenters())
    kept = sorted(sizes)
    return centres[kept], np.array([sizes[i] for i in kept])


def agglomerative(df: DataFrame, id_column: str, features, n_clusters: int | None = 2, linkage: str = "ward",
                  metric: str = "euclidean", distance_threshold: float | None = None,
                  summaries: int = SUMMARIES, seed: int = 42) -> DataFrame:
    """(id, cluster). Single linkage is exact at any size, the others up to ``summaries`` distinct points.

    Single linkage with a threshold is the components of the graph of points closer than
    that, with a number of clusters a minimum spanning tree without its longest edges. For
    ward, average and complete linkage more points than ``summaries`` are first summarised by
    weighted centroids.
    """
    if linkage == "single" and distance_threshold is not None:
        below = float(np.nextafter(distance_threshold, 0.0))
        return dbscan(df, id_column, features, eps=below, min_samples=1, metric=metric).drop("core")
    p = {"euclidean": 2.0, "l2": 2.0, "manhattan": 1.0, "l1": 1.0}[metric]
    rows = df.select(F.col(id_column).alias("id"), as_array(df, features).alias("x"))
    distinct = cut(rows.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "distinct")
    if linkage == "single":
        placed = cut(with_position(distinct, ["x"], "pid"), "placed")
        labels = placed.join(single_linkage(placed.select("pid", "x"), n_clusters, p), "pid").select("x", F.col("w").alias("n"), "cluster")
        return lookup(rows, cut(labels, "labels"), "x", "x", "cluster").select(F.col("id").alias(id_column), "cluster")
    points, sizes = _summaries(distinct, summaries, seed)
    labels = cut_tree(len(points), merge_tree(points, sizes, linkage, p), n_clusters, distance_threshold)
    # Equal rows have one centre, so only distinct points are compared with all of them.
    placed = cut(distinct.withColumn("pid", F.monotonically_increasing_id()), "placed")
    found = assign(placed.select(F.col("pid").alias("id"), "x"), points, labels).withColumnRenamed("id", "pid")
    named = cut(placed.join(found, "pid").select("x", F.col("w").alias("n"), "cluster"), "labels")
    return lookup(rows, named, "x", "x", "cluster").select(F.col("id").alias(id_column), "cluster")


def birch(df: DataFrame, id_column: str, features, threshold: float = 0.5, n_clusters: int | None = 3, seed: int = 42) -> DataFrame:
    """(id, cluster) from clustering features (count, linear sum) of small cells.

    A cell's radius stays below ``threshold``. Features combine on the map side, so a crowded
    cell costs one row per task. The cells' centroids are clustered by weighted KMeans;
    without ``n_clusters`` every cell is a cluster, numbered in the order of its key.
    """
    rows = df.select(F.col(id_column).alias("id"), as_array(df, features).alias("x"))
    width = len(rows.first().x)
    rows = rows.withColumn("cell", grid_key(F.col("x"), 2 * threshold / width**0.5, list(range(width))))
    cells = cut(rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("x")[j]) for j in range(width)]).alias("x")), "cells")
    if n_clusters is None:
        labels = with_position(cells, ["cell"], "cluster").select("cell", "n", "cluster")
    else:
        vectors = cells.select("cell", "n", array_to_vector("x").alias("features"), F.col("n").cast("double").alias("w"))
        model = KMeans(k=n_clusters, seed=seed, maxIter=100, weightCol="w").fit(vectors)
        labels = model.transform(vectors).select("cell", "n", F.col("prediction").cast("long").alias("cluster"))
    return lookup(rows.select("id", "cell"), cut(labels, "labels"), "cell", "cell", "cluster").select(F.col("id").alias(id_column), "cluster")
