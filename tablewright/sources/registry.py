"""The model registry: an append-only table with one row per trained model."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.learners.base import save_model
from tablewright.operators.lookup import lookup

REGISTRY_SCHEMA = (
    "model_id string, dataset_id string, model_name string, train_time double, metrics map<string,double>, "
    "progress array<double>, path string, ts timestamp, labels string"
)


def append_model(spark: SparkSession, base: str, dataset_id: str, trained, model_id: str) -> str:
    """Save a trained model, or the labels of a clustering without one, under its own path and append its registry row."""
    path, labels = f"{base}/models/{model_id}", f"{base}/labels/{model_id}"
    if trained.model is not None:
        save_model(trained.model, path)
    if trained.labels is not None:
        trained.labels.write.mode("overwrite").parquet(labels)
    scores = {k: float(v) for k, v in trained.metrics.items() if v is not None}
    row = (model_id, dataset_id, trained.name, float(trained.train_time), scores, [float(v) for v in trained.progress],
           path if trained.model is not None else None, None, labels if trained.labels is not None else None)
    rows = spark.createDataFrame([row], REGISTRY_SCHEMA).withColumn("ts", F.timestamp_micros(F.lit(time.time_ns() // 1000)))
    rows.coalesce(1).write.mode("append").parquet(f"{base}/registry")
    return model_id


def read_registry(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{base}/registry")


def read_labels(spark: SparkSession, base: str, model_id: str) -> DataFrame:
    """The rows a clustering was fitted on with their ``cluster``, as its registry row names them."""
    found = read_registry(spark, base).where(F.col("model_id") == model_id).select("labels").first()
    if found is None or found.labels is None:
        raise ValueError(f"no labels are stored for {model_id!r}")
    return spark.read.parquet(found.labels)


def model_metrics(registry: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Scores of a dataset's models: rates default to 0, errors stay null."""
    rows = registry if dataset_id is None else registry.where(F.col("dataset_id") == dataset_id)
    rate = lambda key: F.coalesce(F.try_element_at("metrics", F.lit(key)), F.lit(0.0))
    return rows.select(
        F.col("model_id"), F.col("model_name").alias("name"), rate("accuracy").alias("accuracy"), rate("precision").alias("precision"),
        rate("recall").alias("recall"), rate("f1").alias("f1"), F.coalesce("train_time", F.lit(0.0)).alias("training_time"),
        F.try_element_at("metrics", F.lit("mse")).alias("mse"), F.try_element_at("metrics", F.lit("r2")).alias("r2"),
    )


def find_model(datasets: DataFrame, model_id: str | None = None, models: str = "models") -> DataFrame:
    """Entries of the nested model array, or the one with the given id."""
    rows = datasets.select(*[c for c in datasets.columns if c != models], F.inline(models))
    return rows if model_id is None else rows.where(F.col("model_id") == model_id)


def array_append(values: Column, value: Column) -> Column:
    """Append, starting an array where there is none."""
    return F.when(values.isNull(), F.array(value)).otherwise(F.array_append(values, value))


def array_add(values: Column, value: Column) -> Column:
    """Append unless already present; repeated entries already there stay."""
    return F.when(F.coalesce(F.array_contains(values, value), F.lit(False)), values).otherwise(array_append(values, value))


def array_pull(values: Column, value: Column) -> Column:
    """Remove every occurrence."""
    return F.array_remove(values, value)


def dataset_names(owners: DataFrame, ids: str, datasets: DataFrame, key: str, name: str, missing: str = "Unknown Dataset") -> DataFrame:
    """One row per id in each owner's list with the dataset's name."""
    each = owners.withColumn(key, F.explode(ids)).drop(ids)
    names = datasets.select(key, F.col(name).alias("dataset_name"))
    joined = lookup(each, names, key, key, "dataset_name")
    return joined.withColumn("dataset_name", F.coalesce("dataset_name", F.lit(missing)))
