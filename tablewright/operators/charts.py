"""Bounded x/y data for a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.ordering import with_position
from tablewright.operators.statistics import present


def chart_data(
    df: DataFrame, x: str, y: str, limit: int | None = None, compat: bool = False, order: str | None = None
) -> DataFrame:
    """(x, y) pairs without missing values.

    ``compat`` drops missing values per column and pairs the n-th remaining x
    with the n-th remaining y in the order of the unique column ``order``.
    """
    if not compat:
        pairs = df.where(present(df, x) & present(df, y)).select(F.col(x).alias("x"), F.col(y).alias("y"))
    else:
        side = lambda c, a: with_position(
            df.where(present(df, c)).select(F.col(order).alias("_o"), F.col(c).alias(a)), ["_o"]
        ).drop("_o")
        pairs = side(x, "x").join(side(y, "y"), "position").select("x", "y")
    return pairs.limit(limit) if limit else pairs
