"""KMeans and its mini-batch form."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.vectors import as_array, nearest
from tablewright.learners.base import TableModel
from tablewright.operators.neighbours import nearest_neighbours
from tablewright.runtime import BROADCAST_ROWS, bounded_count, cut


class CentresModel(TableModel):
    """prediction = label of the nearest centre."""

    def transform(self, df: DataFrame) -> DataFrame:
        best = nearest(as_array(df, "features"), self.centres)["i"]
        labels = F.array(*[F.lit(int(v)) for v in self.labels]) if self.labels else None
        return df.withColumn("prediction", best if labels is None else F.get(labels, best))

    def inertia(self, df: DataFrame) -> float:
        return df.agg(F.sum(nearest(as_array(df, "features"), self.centres)["d"])).first()[0] or 0.0


def assign(df: DataFrame, centres: np.ndarray, labels=None) -> DataFrame:
    """(id, cluster) of ``df(id, x)`` by nearest centre, for any number of centres."""
    names = range(len(centres)) if labels is None else labels
    table = df.sparkSession.createDataFrame(
        [(i, [float(v) for v in c], int(n)) for i, (c, n) in enumerate(zip(centres, names))], "rid long, x array<double>, cluster long")
    found = nearest_neighbours(df.select(F.col("id").alias("qid"), "x"), table, 1)
    return found.select(F.col("qid").alias("id"), "cluster")


def kmeans(df: DataFrame, hyper: dict):
    """Lloyd's iterations from k-means||; of ``n_init`` starts the cheapest is kept.

    Where few rows are distinct, equal ones act as one with a weight.
    """
    seeds = hyper.pop("n_init", 1)
    seeds = 1 if seeds == "auto" else int(seeds)
    seed = int(hyper.pop("random_state", None) or 42)
    init = hyper.pop("init", "k-means++")
    options = dict(k=int(hyper.pop("n_clusters", 8)), maxIter=int(hyper.pop("max_iter", 300)), tol=float(hyper.pop("tol", 1e-4)),
                   initMode="random" if init == "random" else "k-means||")
    best, rows = None, df
    distinct = df.select(as_array(df, "features").alias("x")).groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if bounded_count(distinct, BROADCAST_ROWS) <= BROADCAST_ROWS:
        rows = cut(distinct.select(array_to_vector("x").alias("features"), "w"), "distinct")
        options["weightCol"] = "w"
    for i in range(seeds):
        model = KMeans(seed=seed + i, **options).fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best, [best.summary.trainingCost]


def batch_update(batch: DataFrame, centres: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One mini-batch step (Sculley 2010): each centre moves toward its batch mean by batch / all seen."""
    width = centres.shape[1]
    sums = batch.select("x", nearest(F.col("x"), centres)["i"].alias("i")).groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[j]) for j in range(width)]).collect()  # one row per centre
    centres, seen = centres.copy(), seen.copy()
    for r in sums:
        seen[r.i] += r.n
        centres[r.i] += (np.array(r[2:]) - centres[r.i]) * (r.n / seen[r.i])
    return centres, seen


def minibatch_kmeans(df: DataFrame, hyper: dict):
    """All batches are drawn in one pass over the table; the steps read only the drawn rows."""
    k, size = int(hyper.pop("n_clusters", 8)), int(hyper.pop("batch_size", 1024))
    steps, seed = int(hyper.pop("max_iter", 100)), int(hyper.pop("random_state", None) or 42)
    patience, tol = hyper.pop("max_no_improvement", 10), float(hyper.pop("tol", 0.0) or 0.0)
    first_size = int(hyper.pop("init_size", None) or 3 * size)
    rows = df.select(as_array(df, "features").alias("x"), "features")
    n = rows.count()
    wanted = steps * size + first_size
    step = F.floor(F.rand(seed + 1) * (steps + first_size / size)).cast("int").alias("step")
    drawn = cut(rows.sample(min(1.0, wanted / n), seed=seed).select("x", "features", step), "batches")
    start = KMeans(k=k, seed=seed, maxIter=1).fit(drawn.where(F.col("step") >= steps) if n > wanted else drawn)
    centres = np.array(start.clusterCenters())
    seen, history, stale = np.zeros(len(centres)), [], 0
    for i in range(steps):
        moved, seen = batch_update(drawn.where(F.col("step") == i), centres, seen)
        shift = float(((moved - centres) ** 2).sum())
        centres = moved
        stale = stale + 1 if history and shift >= min(history) else 0
        history.append(shift)
        if shift <= tol or (patience and stale >= patience):
            break
    return CentresModel(centres=centres.tolist(), labels=None), history
