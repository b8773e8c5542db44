"""Positions in a global order, without sorting everything in one task."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.runtime import BROADCAST_ROWS, bounded_count, cut

_WITHIN = (1 << 33) - 1


def with_position(df: DataFrame, order: Sequence[str], name: str = "position", small: int = BROADCAST_ROWS) -> DataFrame:
    """Add each row's 0-based place in the order of unique columns ``order``.

    Rows are range-partitioned and sorted within partitions; only one row count
    per partition reaches the driver. A table of at most ``small`` rows is
    numbered by one window.
    """
    if bounded_count(df, small) <= small:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long") - 1)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stamped = cut(
        ordered.withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))),
        "ordered",
    )
    sizes = sorted(tuple(r) for r in stamped.groupBy("_part").count().collect())
    offsets, start = [], 0
    for part, n in sizes:
        offsets.append((part, start))
        start += n
    table = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return (
        stamped.join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_start") + F.col("_seq"))
        .drop("_part", "_seq", "_start")
    )
