"""Helpers for tables of documents: row numbers and written intermediate tables."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.ordering import with_position
from tablewright.runtime import cut


def settled(df: DataFrame, label: str) -> DataFrame:
    """``cut``, then let Spark drop the shuffle files of the job, which nothing reads any more.

    Spark's cleaner frees them when the driver collects garbage, which may be long after.
    """
    out = cut(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def numbered(docs: DataFrame, name: str = "_n") -> DataFrame:
    """``docs`` with a number that tells its rows apart and rises with doc_id.

    That is doc_id itself where no row lacks it or shares it. Otherwise rows are numbered by
    doc_id, nulls first, and by text; rows equal in both are numbered in any order, which
    exchanges equal rows at most.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return with_position(docs, ["doc_id", "text"], name)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others in one struct, so that no name of theirs gets in the way."""
    rest = [c for c in docs.columns if c not in own]
    filling = "_" * (1 + max((len(c) for c in rest), default=0))  # a struct needs a field; no column has this name
    return docs.select(*own, F.struct(F.lit(0).alias(filling), *[quoted(c).alias(c) for c in rest]).alias("others"))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unpacked(docs: DataFrame, columns: list[str], *plain: str, **own: Column) -> DataFrame:
    """The columns of a ``packed`` table in their order: ``plain`` ones as they are, those in ``own`` replaced or added."""
    parts = [own.get(c, F.col(c) if c in plain else F.col("others").getField(c)).alias(c) for c in columns]
    return docs.select(*parts, *[value.alias(c) for c, value in own.items() if c not in columns])
