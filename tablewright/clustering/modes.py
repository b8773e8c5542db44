"""Mean shift with a flat kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.clustering.bandwidth import estimate_bandwidth
from tablewright.functions.vectors import as_array, squared_distance
from tablewright.operators.neighbours import nearest_neighbours
from tablewright.operators.proximity import widest, within
from tablewright.runtime import cut

def mean_shift(df: DataFrame, id_column: str, features, bandwidth: float | None = None, min_bin_freq: int = 1,
               cluster_all: bool = True, max_iter: int = 300) -> DataFrame:
    """(id, cluster): seeds start at occupied bins and move to the mean of the points within the bandwidth.

    Only seeds still moving are joined again; the means combine on the map side.
    Modes are numbered from the most populated; rows far from every mode are -1
    when ``cluster_all`` is off.
    """
    given = df.select(F.col(id_column).alias("id"), as_array(df, features).alias("x"))
    points = cut(given.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "points")
    width = len(points.first().x)
    bandwidth = bandwidth or estimate_bandwidth(points)
    dims = widest(points, "x", width)
    # bins are centred on multiples of the bandwidth
    bins = points.select(F.transform("x", lambda v: F.bround(v / F.lit(bandwidth)) * F.lit(bandwidth)).alias("y"), "w")
    seeds = bins.groupBy("y").agg(F.sum("w").alias("n")).where(F.col("n") >= min_bin_freq).select("y")
    moving, settled = cut(seeds, "seeds"), None
    for _ in range(max_iter):
        near = within(points, moving, bandwidth, dims)
        means = near.groupBy("y").agg(
            F.sum("w").alias("n"),
            F.array(*[F.sum(F.col("x")[j] * F.col("w")) / F.sum("w") for j in range(width)]).alias("z"))
        shifted = cut(means.select("n", "z", (squared_distance(F.col("y"), F.col("z")) < (1e-3 * bandwidth) ** 2).alias("done")), "shifted")
        stopped = shifted.where("done").select(F.col("z").alias("y"), "n")
        settled = stopped if settled is None else settled.union(stopped)
        moving = shifted.where("not done").select(F.col("z").alias("y")).distinct()
        if moving.isEmpty():
            break
    else:
        settled = settled.union(shifted.where("not done").select(F.col("z").alias("y"), "n"))
    modes = cut(_strongest(cut(settled.groupBy("y").agg(F.max("n").alias("n")), "modes"), bandwidth, dims), "kept")
    # Few modes remain: none lies within a bandwidth of a stronger one.
    ordered = [r.y for r in modes.orderBy(F.desc("n"), F.desc("y")).collect()]
    table = df.sparkSession.createDataFrame([(i, y) for i, y in enumerate(ordered)], "rid long, x array<double>")
    found = nearest_neighbours(given.select(F.col("id").alias("qid"), "x"), table, 1)
    label = F.col("rid") if cluster_all else F.when(F.col("distance") <= bandwidth, F.col("rid")).otherwise(F.lit(-1))
    return found.select(F.col("qid").alias(id_column), label.cast("long").alias("cluster"))


def _strongest(modes: DataFrame, bandwidth: float, dims: list[int]) -> DataFrame:
    """Keep modes from the most populated down, dropping those within a bandwidth of a kept one."""
    kept, rest = None, modes
    while not rest.isEmpty():
        left = rest.select(F.col("y").alias("x"), F.col("n").alias("m"))
        pairs = cut(within(left, rest, bandwidth, dims).where("x <> y").select("x", "m", "y", "n"), "pairs")
        beaten = pairs.where("struct(n, y) > struct(m, x)").select(F.col("x").alias("y")).distinct()
        top = cut(rest.join(beaten, "y", "left_anti"), "top")
        kept = top if kept is None else kept.union(top)
        covered = pairs.join(top.select("y"), "y").select(F.col("x").alias("y")).distinct()
        rest = cut(rest.join(top.select("y").union(covered), "y", "left_anti"), "rest")
    return kept
