"""What every fitted model of our own shares: transform, save and load."""

from __future__ import annotations

import importlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


class TableModel:
    """A model whose state is a JSON-able ``params`` dict."""

    def __init__(self, **params: Any):
        self.params = params

    def __getattr__(self, name: str):
        params = self.__dict__.get("params", {})
        if name in params:
            return params[name]
        raise AttributeError(name)

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def save(self, path: str) -> None:
        kind = type(self)
        row = [(kind.__module__, kind.__qualname__, json.dumps(self.params))]
        SparkSession.active().createDataFrame(row, "module string, kind string, params string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/model")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, params: dict) -> "TableModel":
        return cls(**params)


class RelabelledModel(TableModel):
    """A classifier fitted on 0, 1, ..., k - 1 that predicts the labels it was given."""

    def transform(self, df: DataFrame, *more) -> DataFrame:
        named = F.get(F.array(*[F.lit(float(v)) for v in self.classes]), F.col("prediction").cast("int"))
        return self.inner.transform(df, *more).withColumn("prediction", named)

    def save(self, path: str) -> None:
        super().save(path)
        save_model(self.inner, f"{path}/inner")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, params: dict) -> "RelabelledModel":
        model = cls(**params)
        model.inner = load_model(spark, f"{path}/inner")
        return model


def save_model(model, path: str) -> str:
    """Save a model of ours or of Spark's."""
    if isinstance(model, TableModel):
        model.save(path)
    else:
        model.write().overwrite().save(f"{path}/native")
        SparkSession.active().createDataFrame(
            [(type(model).__module__, type(model).__qualname__, "native")], "module string, kind string, params string"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return path


def load_model(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/model").first()
    kind = getattr(importlib.import_module(row.module), row.kind)
    if row.params == "native":
        return kind.load(f"{path}/native")
    return kind.restore(spark, path, json.loads(row.params))


def take(hyper: dict, **names: str) -> dict:
    """Pick the given hyper-parameters out of ``hyper`` under their Spark names."""
    return {spark: hyper.pop(own) for own, spark in names.items() if hyper.get(own) is not None}
