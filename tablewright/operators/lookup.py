"""Joining a large table to a table of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.runtime import BROADCAST_ROWS, bounded_count, cut

SALTS = 64
# Most bytes a broadcast table may hold.
BROADCAST_BYTES = 64 << 20
# A value held by more than this share of the rows is looked up without a shuffle.
HOT_SHARE = 1 / 2000


def lookup(df: DataFrame, table: DataFrame, on: str, key: str, value: str, small: int = BROADCAST_ROWS) -> DataFrame:
    """Left join ``table`` (unique ``key`` -> ``value``, optional row count ``n``) to column ``on``.

    A table of checked rows and bytes is broadcast; a larger one is joined by ``spread_lookup``.
    """
    if bounded_count(table, small) <= small and _bytes(table, key, value) <= BROADCAST_BYTES:
        return df.join(
            F.broadcast(table.select(F.col(key).alias("_k"), F.col(value).alias(value))),
            F.col(on) == F.col("_k"), "left",
        ).drop("_k")
    if "n" not in table.columns:
        counts = df.where(F.col(on).isNotNull()).groupBy(F.col(on).alias(key)).agg(F.count(F.lit(1)).alias("n"))
        table = cut(table.join(counts, key), "counted")
    return spread_lookup(df, table, on, key, value, table.agg(F.sum("n")).first()[0])


def _bytes(table: DataFrame, *columns: str) -> int:
    """About the bytes of the given columns; numbers count 8 each."""
    def width(c: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
        return F.lit(8 * (1 + len(kind.fields)) if isinstance(kind, T.StructType) else 8)

    plain = [width(c, table.schema[c].dataType) for c in columns]
    if all(isinstance(table.schema[c].dataType, (T.NumericType, T.BooleanType)) for c in columns):
        return 0  # the row bound is enough
    return table.agg(F.sum(sum(plain, F.lit(0).cast("long")))).first()[0] or 0


def spread_lookup(df: DataFrame, table: DataFrame, on: str, key: str, value: str, rows: int) -> DataFrame:
    """Left join on a key some values of which may hold a large share of the ``rows``.

    The values with more than ``HOT_SHARE`` of the rows, at most 1 / HOT_SHARE of
    them, are broadcast. Their rows then carry a salt that matches nothing, so they
    spread over the shuffle in which everything else meets.
    """
    frequent = F.col("n") > F.lit(rows * HOT_SHARE)
    hot = table.where(frequent).select(F.col(key).alias("_hk"), F.col(value).alias("_hv"))
    cold = table.where(~frequent).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(0).alias("_s"))
    first = df.join(F.broadcast(hot), F.col(on) == F.col("_hk"), "left")
    done = F.col("_hk").isNotNull() | F.col(on).isNull()
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    anywhere = F.pmod(F.xxhash64(*(plain[:8] or [F.col(on)])), F.lit(SALTS)).cast("int") + 1
    salted = first.withColumn("_salt", F.when(done, anywhere).otherwise(F.lit(0)))
    joined = salted.join(cold, (F.col(on) == F.col("_k")) & (F.col("_salt") == F.col("_s")), "left")
    return joined.withColumn(value, F.coalesce("_hv", "_v")).drop("_hk", "_hv", "_salt", "_k", "_v", "_s")
