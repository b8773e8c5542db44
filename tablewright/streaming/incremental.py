"""Incremental forms of cleaning, scoring, de-duplication and clustering."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.clustering.centres import batch_update
from tablewright.operators.cleaning import CleaningModel

# Fixed value: how often new files are looked for when a stream keeps running.
POLL = "5 minutes"


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of newly landed files; each file is taken exactly once."""
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)


def clean_stream(stream: DataFrame, model: CleaningModel, out: str, checkpoint: str, once: bool = True,
                 time_column: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Clean new rows by a model fitted on the history, so all batches get one schema and the same fills.

    Duplicates are dropped across batches. With ``time_column`` the state for that is bounded:
    rows are compared within ``delay`` of event time. Without it all rows seen are remembered.
    """
    cleaned = model.transform(stream)
    if model.remove_duplicate:
        keys = [c for c in cleaned.columns if c != time_column]
        cleaned = dedupe_stream(cleaned, keys, time_column, delay) if time_column else cleaned.dropDuplicates()
    return write_stream(cleaned, out, checkpoint, once)


def score_stream(stream: DataFrame, model) -> DataFrame:
    """A fitted transformer or model applied to a stream: stateless, no shuffle."""
    return model.transform(stream)


def dedupe_stream(stream: DataFrame, keys: list[str], time_column: str, delay: str = "1 day") -> DataFrame:
    """First row of each key within ``delay``; state older than that is dropped."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


def write_stream(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return _trigger(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), once).start()


def kmeans_stream(stream: DataFrame, start: np.ndarray, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Mini-batch KMeans over ``stream(x array<double>)``.

    After each batch the centres and how many rows each has seen are written under
    the batch's number; a replayed batch starts from its predecessor's state.
    """
    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        centres, seen = read_centres(spark, out, before=batch_id) or (np.asarray(start, float), np.zeros(len(start)))
        centres, seen = batch_update(batch, centres, seen)
        rows = [(i, [float(v) for v in c], float(s)) for i, (c, s) in enumerate(zip(centres, seen))]
        state = spark.createDataFrame(rows, "i int, centre array<double>, seen double")
        state.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _trigger(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(update), once).start()


def read_centres(spark: SparkSession, out: str, before: int | None = None):
    """(centres, seen) after the latest batch, or the latest one before ``before``."""
    try:
        states = spark.read.parquet(out)
    except AnalysisException:
        return None
    if before is not None:
        states = states.where(F.col("batch") < before)
    latest = states.agg(F.max("batch")).first()[0]
    if latest is None:
        return None
    rows = states.where(F.col("batch") == latest).orderBy("i").collect()  # one row per centre
    return np.array([r.centre for r in rows]), np.array([r.seen for r in rows])
