"""Repeatable train/test splits."""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.hashing import hash_fraction
from tablewright.operators.statistics import select_ranks


def is_test(key: Sequence[str] | str, percentage: float = 30, seed: int = 42) -> Column:
    """True for about ``percentage`` % of the rows, decided by the key alone: no shuffle."""
    return hash_fraction(key, seed) < F.lit(percentage / 100.0)


def with_split(df: DataFrame, key: Sequence[str] | str, percentage: float = 30, seed: int = 42) -> DataFrame:
    return df.withColumn("split", F.when(is_test(key, percentage, seed), "test").otherwise("train"))


def exact_split(df: DataFrame, key: Sequence[str] | str, percentage: float = 30, seed: int = 42) -> DataFrame:
    """Exactly ``ceil(n * p)`` test rows: those with the smallest key hashes.

    The cut-off hash is found by rank selection instead of a global sort. Of the
    hash 52 bits are used, so that distinct keys practically never share it.
    """
    fraction = hash_fraction(key, seed, digits=13)
    found = select_ranks(
        df, {"h": fraction}, lambda n: (max(0, math.ceil(n * percentage / 100.0) - 1),) * 2
    )["h"]
    if found is None or percentage <= 0:
        return df.withColumn("split", F.lit("train"))
    return df.withColumn("split", F.when(fraction <= F.lit(found[0]), "test").otherwise("train"))


def train_test(df: DataFrame, key: Sequence[str] | str | None = None, percentage: float = 30, seed: int = 42):
    """(train, test); with no key the whole row decides, so equal rows stay together."""
    side = is_test(list(key) if key else df.columns, percentage, seed)
    return df.where(~side), df.where(side)
