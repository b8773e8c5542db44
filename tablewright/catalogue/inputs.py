"""Inputs of the registered queries, each derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same text runs in Spark and in the checking engine.
_DIRTY = {
    "o_orderkey": "o_orderkey",
    "price": "case when o_orderkey % 7 = 0 then null else o_totalprice end",
    "prio": "case when o_orderkey % 11 = 0 then null else o_orderpriority end",
    "odate": "case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) end",
    "status": "case when o_orderkey % 5 = 0 then concat(' ', upper(o_orderstatus), ' ') else lower(o_orderstatus) end",
    "price_txt": "case when o_orderkey % 17 = 0 then 'oops' else cast(o_totalprice as varchar(30)) end",
    "qty_txt": "case when o_orderkey % 19 = 0 then 'n/k' else cast(o_custkey % 50 as varchar(30)) end",
    "flag": "case o_orderkey % 6 when 0 then 'Yes' when 1 then ' no' when 2 then 'TRUE' when 3 then '0' "
            "when 4 then 'maybe' else null end",
    "dur": "case o_orderkey % 4 when 0 then concat(cast(o_custkey % 9 as varchar(9)), ' days 0', cast(o_custkey % 10 as varchar(9)), ':30:15') "
           "when 1 then concat('1', cast(o_custkey % 10 as varchar(9)), ':05:09') "
           "when 2 then 'soon' else concat(cast(o_custkey % 50 as varchar(9)), ' days') end",
    "cplx": "case when o_orderkey % 6 = 0 then 'x' else concat(cast(o_custkey % 7 as varchar(9)), '+', cast(o_custkey % 5 as varchar(9)), 'j') end",
    "clock": "case when o_orderkey % 9 = 0 then 'late' else concat('2020-01-0', cast(o_custkey % 9 + 1 as varchar(9)), ' 1', cast(o_custkey % 10 as varchar(9)), ':05:09') end",
}
DIRTY_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _DIRTY.items()) + " from orders"


def dirty_orders(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = columns or tuple(_DIRTY)
    return table(spark, sf_dir, "orders").selectExpr(*[f"{_DIRTY[n]} as {n}" for n in names])


# A key of lineitem, and targets that can be learned from it.
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_LINES = {
    "k": "concat_ws('|', cast(l_orderkey as varchar(20)), cast(l_linenumber as varchar(20)), "
         "cast(l_partkey as varchar(20)), cast(l_suppkey as varchar(20)))",
    "qty": "l_quantity",
    "disc": "l_discount",
    "tax": "l_tax",
    "flag": "l_returnflag",
    "y": "3 + 2 * l_quantity - 50 * l_discount + 10 * l_tax + ((l_orderkey * 31 + l_linenumber * 17) % 11 - 5) / 10.0e0",
    "two": "case when l_quantity > 25 and l_discount < 0.06 then 1 else 0 end",
    "three": "case when l_quantity < 17 then 0 when l_quantity < 34 then 1 else 2 end",
}
LINES_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _LINES.items()) + " from lineitem"


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    names = columns or tuple(_LINES)
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{_LINES[n]} as {n}" for n in names])


# The repeatable split as SQL text: true for a test row.
def split_sql(key: str, share: float = 0.3) -> str:
    return f"cast(('0x' || substr(md5('42:' || {key}), 1, 8)) as bigint) / 4294967296.0::double < {share}"


# Three separated squares of points, as many distinct ones as rows.
_BLOBS = {
    "id": "o_orderkey",
    "x": "10.0e0 * (o_orderkey % 3) + (o_orderkey * 7919 % 1000003) / 1000003.0e0",
    "y": "10.0e0 * ((o_orderkey % 3) % 2) + (o_orderkey * 104729 % 1000003) / 1000003.0e0",
    "truth": "cast(o_orderkey % 3 as int)",
}
BLOBS_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _BLOBS.items()) + " from orders"


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _BLOBS.items()])


# Two rings in space, each through the middle of the other.
_RINGS = {
    "id": "o_orderkey",
    "x": "case when o_orderkey % 2 = 0 then 0.0e0 else 1.0e0 end + cos((o_orderkey * 7919 % 1000003) / 1000003.0e0 * 6.283185307179586)",
    "y": "case when o_orderkey % 2 = 0 then sin((o_orderkey * 7919 % 1000003) / 1000003.0e0 * 6.283185307179586) else 0.0e0 end",
    "z": "case when o_orderkey % 2 = 0 then 0.0e0 else sin((o_orderkey * 7919 % 1000003) / 1000003.0e0 * 6.283185307179586) end",
    "truth": "cast(o_orderkey % 2 as int)",
}
RINGS_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _RINGS.items()) + " from orders"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in _RINGS.items()])
