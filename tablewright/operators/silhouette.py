"""Silhouette coefficients of all rows over plain or squared Euclidean distance."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.blocks import matrix, product_distances, row_slices
from tablewright.functions.vectors import as_array, constant, dot
from tablewright.operators.distance_sums import mean_score
from tablewright.runtime import BROADCAST_ROWS, cut, fits_broadcast

BLOCK_ROWS = 32_768
# Up to so many columns and clusters, far points of many are summed by grids.
GRID_COLUMNS, GRID_CLUSTERS = 3, 1_000


def _points(df: DataFrame, features, label: str) -> DataFrame:
    """Distinct (x, c) with how often they occur; copies combine on the map side."""
    return df.select(as_array(df, features).alias("x"), F.col(label).cast("long").alias("c")).groupBy("x", "c").agg(
        F.count(F.lit(1)).alias("w"))


def silhouette(df: DataFrame, features, label: str, broadcast_rows: int = BROADCAST_ROWS,
               block_rows: int = BLOCK_ROWS) -> float | None:
    """Mean silhouette over all rows, or None with fewer than two labels.

    Plain Euclidean distance sums cannot be taken apart by cluster. In more than
    ``GRID_COLUMNS`` columns the work is quadratic in the number of distinct points
    (``silhouette_squared`` is linear): distance sums per cluster are formed inside
    blocks, and pairs are never rows. In fewer, far points act by grids, which keeps
    nine digits of the sums.
    """
    points = cut(_points(df, features, label), "points")
    sizes = {r.c: r.n for r in points.groupBy("c").agg(F.sum("w").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    n, width = points.count(), len(points.first().x)
    spark = df.sparkSession
    if n <= broadcast_rows and fits_broadcast(n, width):
        rows = points.toPandas()
        codes, labels = pd.factorize(rows["c"], sort=True)
        weight = np.zeros((n, len(labels)))
        weight[np.arange(n), codes] = rows["w"]
        sent = spark.sparkContext.broadcast((matrix(rows["x"], width), weight, labels.to_numpy()))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            others, weights, names = sent.value
            size = weights.sum(axis=0)
            for pdf in batches:
                for part in row_slices(len(pdf), len(others)):
                    rows_, mine = pdf.iloc[part], np.searchsorted(names, pdf["c"].to_numpy()[part])
                    sums = product_distances(matrix(rows_["x"], width), others) @ weights
                    at = np.arange(len(rows_))
                    own = sums[at, mine] / np.maximum(size[mine] - 1, 1)
                    means = sums / size
                    means[at, mine] = np.inf
                    other = means.min(axis=1)
                    value = np.where(size[mine] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
                    yield pd.DataFrame({"s": value, "w": rows_["w"].to_numpy()})

        scored = points.mapInPandas(score, "s double, w long")
        return scored.agg(F.sum(F.col("s") * F.col("w")) / F.sum("w")).first()[0]

    if width <= GRID_COLUMNS and len(sizes) <= GRID_CLUSTERS:
        return mean_score(points, sizes, n, width)

    # Random blocks of equal size: every pair of blocks meets once, in its own task.
    blocks = math.ceil(n / block_rows)
    numbered = cut(points.withColumn("i", F.monotonically_increasing_id()), "numbered")
    tagged = numbered.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = tagged.select("i", "x", F.col("b").alias("a"), every.alias("b"))
    right = tagged.select("x", "c", "w", "b", every.alias("a"))

    def sums_of(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        codes, labels = pd.factorize(r["c"], sort=True)
        weight = np.zeros((len(r), len(labels)))
        weight[np.arange(len(r)), codes] = r["w"]
        points_, asking, names = matrix(r["x"], width), matrix(q["x"], width), q["i"].to_numpy()
        out = []
        for part in row_slices(len(q), max(1, len(r))):
            sums = product_distances(asking[part], points_) @ weight
            out.append(pd.DataFrame({"i": np.repeat(names[part], len(labels)), "o": np.tile(np.asarray(labels), len(sums)), "t": sums.ravel()}))
        return pd.concat(out) if len(q) and len(r) else pd.DataFrame({"i": [], "o": [], "t": []})

    sums = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(sums_of, "i long, o long, t double")
    totals = sums.groupBy("i", "o").agg(F.sum("t").alias("t"))
    size_table = F.broadcast(spark.createDataFrame(list(sizes.items()), "o long, n long"))
    return _mean_score(totals.join(size_table, "o"), numbered.select("i", "c", "w"))


def _mean_score(totals: DataFrame, points: DataFrame) -> float:
    """From (i, o, t, n): distance sums t of each point to each cluster o of size n; and ``points(i, c, w)``."""
    own = F.col("o") == F.col("c")
    per = totals.join(points, "i").groupBy("i").agg(
        F.first("w").alias("w"),
        F.max(F.when(own, F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"),
        F.max(F.when(own, F.col("n"))).alias("own"),
        F.min(F.when(~own, F.col("t") / F.col("n"))).alias("b"),
    )
    s = F.when(F.col("own") > 1, (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(F.lit(0.0))
    return per.agg(F.sum(s * F.col("w")) / F.sum("w")).first()[0]


def silhouette_squared(df: DataFrame, features, label: str) -> DataFrame:
    """One row: mean silhouette over squared distances, in time linear in the rows.

    The sum of squared distances to a cluster follows from its size, vector sum
    and sum of squared norms, so each row is compared with the clusters only.
    """
    points = df.select(as_array(df, features).alias("x"), F.col(label).cast("long").alias("c"))
    width = len(points.first().x)
    norm = dot(F.col("x"), F.col("x"))
    stats = points.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(width)]
    )
    rows = stats.collect()  # one row per cluster
    table = [{"c": r.c, "n": float(r.n), "q": r.q, "s": [r[f"s{j}"] for j in range(width)]} for r in rows]
    clusters = constant(table, "array<struct<c: bigint, n: double, q: double, s: array<double>>>")
    summed = lambda k: F.greatest(F.lit(0.0), k["n"] * norm - 2.0 * dot(F.col("x"), k["s"]) + k["q"])
    own = F.filter(clusters, lambda k: k["c"] == F.col("c"))[0]
    a = summed(own) / F.greatest(own["n"] - 1.0, F.lit(1.0))
    b = F.array_min(F.transform(F.filter(clusters, lambda k: k["c"] != F.col("c")), lambda k: summed(k) / k["n"]))
    s = F.when(own["n"] > 1, (b - a) / F.greatest(a, b, F.lit(1e-300))).otherwise(F.lit(0.0))
    return points.agg(F.avg(s).alias("silhouette"))
