"""Describing a table: shape, types, missing and distinct values."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.casts import no_nan
from tablewright.operators.statistics import cell, value_counts


def _names(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col") + 1)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"))


def column_types(df: DataFrame) -> DataFrame:
    """(column, dtype); reads the schema only."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def column_names(df: DataFrame) -> DataFrame:
    """(position, column); reads the schema only."""
    return df.sparkSession.createDataFrame(list(enumerate(df.columns)), "position long, column string")


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) from one aggregation over all columns."""
    counts = df.agg(*[
        F.count_if(cell(df, c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)
    ])
    pairs = [x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col(f"c{i}"))]
    return counts.select(F.explode(F.create_map(*pairs)).alias("column", "missing"))


def _column_report(df: DataFrame) -> DataFrame:
    counts = value_counts(df, df.columns)
    empty = F.coalesce("as_text", F.col("as_long").cast("string"), F.col("as_double").cast("string")).isNull()
    return counts.groupBy("col").agg(
        F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(~empty).alias("unique"),
    )


def unique_values(df: DataFrame) -> DataFrame:
    """(column, unique): distinct non-missing values of every column, one scan."""
    return _column_report(df).select(_names(df, df.columns).alias("column"), "unique")


def profile(df: DataFrame) -> DataFrame:
    """(column, dtype, missing, unique) for every column from one scan."""
    dtypes = F.element_at(F.array(*[F.lit(d) for _, d in df.dtypes]), F.col("col") + 1)
    return _column_report(df).select(
        _names(df, df.columns).alias("column"), dtypes.alias("dtype"), "missing", "unique"
    )


def head(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First rows in a declared order."""
    return df.orderBy(*order).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def all_in_set(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """One row: is every cell (a missing one included) among ``values``?"""
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return df.agg(F.coalesce(F.bool_and(inside), F.lit(True)).alias("all_in_set"))


def is_empty(df: DataFrame | None) -> bool:
    return df is None or not df.columns or df.isEmpty()


def infer_types(df: DataFrame) -> dict[str, str]:
    """Narrowest Spark type that reads every cell of each text column, from one pass."""
    checks, texts = [], [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for i, name in enumerate(texts):
        c = F.trim(F.col(f"`{name}`"))
        plain_int = c.rlike(r"^[+-]?\d{1,18}$")
        number = no_nan(F.when(~F.lower(F.substring(c, -1, 1)).isin("d", "f"), c.try_cast("double")), T.DoubleType())
        checks += [
            F.count(c).alias(f"n{i}"),
            F.count_if(plain_int).alias(f"i{i}"),
            F.count_if(number.isNotNull()).alias(f"d{i}"),
            F.count_if(c.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias(f"b{i}"),
        ]
    if not texts:
        return {}
    row = df.agg(F.count(F.lit(1)).alias("total"), *checks).first()
    types = {}
    for i, name in enumerate(texts):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            types[name] = "bigint" if n == row["total"] else "double"
        elif n == 0 or row[f"d{i}"] == n:
            types[name] = "double"
        elif row[f"b{i}"] == row["total"]:
            types[name] = "boolean"
        else:
            types[name] = "string"
    return types
