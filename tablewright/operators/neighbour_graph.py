"""The graph of nearest neighbours of a table's points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.neighbours import nearest_neighbours

# Up to this many points every task holds them all; above, pivots cut the search down.
SENT_POINTS = 5_000


def neighbour_edges(points: DataFrame, k: int, p: float = 2.0, carried: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(u, v, d): each of ``points(pid, x)`` with its ``k`` nearest others, ties to the smaller pid.

    Columns ``carried`` are those of v; ``distinct`` tells that no two points are equal.
    """
    others = points.select(F.col("pid").alias("rid"), *carried, "x")
    found = nearest_neighbours(points.select(F.col("pid").alias("qid"), "x"), others, k + 1, p, broadcast_rows=SENT_POINTS, distinct=distinct)
    return found.where("qid <> rid").select(F.col("qid").alias("u"), F.col("rid").alias("v"), F.col("distance").alias("d"), *carried)
