"""Streaming queries: each drains the events as several files and must equal the batch result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tablewright.catalogue.inputs import table
from tablewright.operators.cleaning import fit_cleaning
from tablewright.operators.features import fit_features
from tablewright.runtime import new_folder
from tablewright.spec import DatasetSpec
from tablewright.streaming import incremental

QUERIES, ORACLES = {}, {}
FILES = 4


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def _micros(df, column: str):
    """Microseconds of a time as it is written; a time without a zone does not pass through that of the session."""
    if df.schema[column].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)")
    return F.unix_micros(F.col(column).cast("timestamp"))


def _landed(spark, sf, df=None):
    """Events landed as a few files, and a stream reading one file per batch."""
    df = table(spark, sf, "events") if df is None else df
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_folder(spark, "landing")
    df.repartitionByRange(FILES, "ts").write.parquet(path)
    return incremental.read_files(spark, path, df.schema, files_per_batch=1)


def _drained(spark, stream, columns):
    out, state = new_folder(spark, "stream"), new_folder(spark, "progress")
    incremental.write_stream(stream, out, state).awaitTermination()
    return spark.read.parquet(out).select(*columns)


@query("stream_clean", "select event_id, lower(trim(event_type)) as event_type, "
       "case when event_id % 7 = 0 then 0.0 else value end as value from events")
def _(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit(" "), F.upper("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    spec = DatasetSpec(types={"event_id": "int", "event_type": "category", "value": "float"}, fill_empty_rows_using="custom_value")
    out, state = new_folder(spark, "stream"), new_folder(spark, "progress")
    incremental.clean_stream(_landed(spark, sf, df), fit_cleaning(df, spec), out, state).awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type", "value")


@query("stream_clean_mean", "with m as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events), "
       "e as (select user_id, event_type, case when epoch_us(ts) >= low + (high - low) * 3 // 10 then value end as value from events, m) "
       "select distinct user_id, event_type, round(coalesce(value, (select avg(value) from e)), 6) as value from e")
def _(spark, sf):
    """A column that is empty in the first file, means of the whole history, and duplicates across files."""
    events = table(spark, sf, "events")
    micros = _micros(events, "ts")
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    late = micros >= low + (high - low) * 3 // 10
    df = events.select("ts", "user_id", "event_type", F.when(late, F.col("value")).alias("value"))
    spec = DatasetSpec(types={"user_id": "int", "event_type": "str", "value": "float"})
    model = fit_cleaning(df.drop("ts"), spec)
    out, state = new_folder(spark, "stream"), new_folder(spark, "progress")
    incremental.clean_stream(_landed(spark, sf, df).drop("ts"), model, out, state).awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("stream_score", "select event_id, round((value - (select avg(value) from events)) / (select stddev_pop(value) from events), 6) as scaled from events")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    events = table(spark, sf, "events")
    model = fit_features(events, DatasetSpec(types={"value": "float"}))
    scored = incremental.score_stream(_landed(spark, sf), model)
    return _drained(spark, scored.select("event_id", F.round(vector_to_array("features")[0], 6).alias("scaled")), ["event_id", "scaled"])


@query("stream_dedupe", "select distinct user_id, event_type from events")
def _(spark, sf):
    stream = incremental.dedupe_stream(_landed(spark, sf), ["user_id", "event_type"], "ts", "3650 days")
    return _drained(spark, stream.select("user_id", "event_type"), ["user_id", "event_type"])


@query("stream_kmeans", "with e as (select cast(event_id % 3 as int) as cluster, 1000.0e0 * (event_id % 3) + user_id % 100 as x from events) "
       "select cluster, round(avg(x), 6) as centre, count(*) as seen from e group by cluster")
def _(spark, sf):
    """Values in three intervals far apart: each centre is the mean of its own, however the rows arrive."""
    apart = F.lit(1000.0) * (F.col("event_id") % 3) + F.col("user_id") % 100
    stream = _landed(spark, sf).select(F.array(apart).alias("x"))
    out, state = new_folder(spark, "stream"), new_folder(spark, "progress")
    incremental.kmeans_stream(stream, np.array([[0.0], [1000.0], [2000.0]]), out, state).awaitTermination()
    centres, seen = incremental.read_centres(spark, out)
    return spark.createDataFrame([(i, round(float(c[0]), 6), int(s)) for i, (c, s) in enumerate(zip(centres, seen))], "cluster int, centre double, seen long")
