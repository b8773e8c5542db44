"""Distances and fixed tables over array<double> columns."""

from __future__ import annotations

import json
from typing import Any, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F


def as_array(df: DataFrame, features: str | Sequence[str]) -> Column:
    """Features as array<double>: a vector column, an array column or plain columns."""
    if not isinstance(features, str):
        return F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    kind = df.schema[features].dataType.typeName()
    if kind == "array":
        return F.col(features).cast("array<double>")
    if kind in ("vector", "udt", "vectorudt"):
        return vector_to_array(F.col(features))
    return F.array(F.col(features).cast("double"))


def constant(value: Any, schema: str) -> Column:
    """A nested constant; Catalyst folds it to one literal at planning."""
    return F.from_json(F.lit(json.dumps({"v": value}, allow_nan=True)), f"v {schema}",
                       {"allowNonNumericNumbers": "true"})["v"]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def minkowski(a: Column, b: Column, p: float = 2.0) -> Column:
    if p == 2:
        return F.sqrt(squared_distance(a, b))
    if p == 1:
        return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if p == float("inf"):
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def nearest(point: Column, centres: Sequence[Sequence[float]]) -> Column:
    """struct(d, i) of the nearest of a few fixed centres; ties go to the lowest index."""
    table = constant([[float(v) for v in c] for c in centres], "array<array<double>>")
    return F.array_min(
        F.transform(table, lambda c, i: F.struct(squared_distance(point, c).alias("d"), i.alias("i")))
    )
