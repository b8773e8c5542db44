"""Grid keys that turn "closer than r" into an equi-join, in any number of dimensions.

Two points within ``r`` differ by at most ``r`` in every coordinate, so their grid
cells of side ``r`` differ by at most one step. Up to three coordinates with the
widest spread form the key; the distance itself is always checked on all of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.blocks import matrix
from tablewright.functions.vectors import minkowski

GRID_DIMENSIONS = 3
# Bits a column gives to a place on a space-filling curve.
_BITS = 20


def widest(df: DataFrame, column: str, width: int, n: int = GRID_DIMENSIONS) -> list[int]:
    """Positions of the coordinates with the widest spread."""
    if width <= n:
        return list(range(width))
    row = df.agg(*[F.stddev_pop(F.col(column)[j]) for j in range(width)]).first()
    return sorted(sorted(range(width), key=lambda j: -(row[j] or 0.0))[:n])


def curve(points: DataFrame, width: int):
    """A function of the column ``x`` of ``points``: the place of a point on a curve along which neighbours lie near each other."""
    dims = widest(points, "x", width)
    ends = points.agg(*[f for j in dims for f in (F.min(F.col("x")[j]), F.max(F.col("x")[j]))]).first()
    low = np.array(ends[0::2])
    scale = ((1 << _BITS) - 1) / np.maximum(np.array(ends[1::2]) - low, 1e-300)

    @F.pandas_udf("long")
    def along(x: pd.Series) -> pd.Series:
        cells = ((matrix(x, width)[:, dims] - low) * scale).astype(np.int64)
        out = np.zeros(len(cells), np.int64)
        for bit in range(_BITS):
            for j in range(len(dims)):
                out |= (cells[:, j] >> bit & 1) << (bit * len(dims) + j)
        return pd.Series(out)

    return along


def grid_key(point: Column, side: float, dims: list[int]) -> Column:
    return F.array(*[F.floor(point[j] / F.lit(side)).cast("long") for j in dims])


def around(key: Column, dims: int, steps: int = 1) -> Column:
    """The key's cell and all cells at most ``steps`` away, one row each."""
    offsets = itertools.product(range(-steps, steps + 1), repeat=dims)
    return F.explode(F.array(*[
        F.array(*[key[i] + F.lit(o) for i, o in enumerate(shift)]) for shift in offsets
    ]))


def within(left: DataFrame, right: DataFrame, radius: float, dims: list[int], p: float = 2.0) -> DataFrame:
    """Rows of ``left(x, ...)`` joined to rows of ``right(y, ...)`` at distance <= radius, as ``d``.

    ``right`` should be the smaller side: it is repeated over the neighbouring cells.
    """
    a = left.withColumn("_key", grid_key(F.col("x"), radius, dims))
    b = right.withColumn("_at", grid_key(F.col("y"), radius, dims)).withColumn("_key", around(F.col("_at"), len(dims))).drop("_at")
    return a.join(b, "_key").drop("_key").withColumn("d", minkowski(F.col("x"), F.col("y"), p)).where(F.col("d") <= radius)
