"""k nearest neighbour classification and regression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.vectors import as_array, dot
from tablewright.learners.base import TableModel
from tablewright.operators.neighbours import nearest_neighbours
from tablewright.runtime import cut

# Minkowski power of each named metric.
POWERS = {"euclidean": 2.0, "l2": 2.0, "manhattan": 1.0, "l1": 1.0, "cityblock": 1.0, "chebyshev": math.inf}


class NeighboursModel(TableModel):
    """Holds the training rows (id, x, label); predicts from the k nearest of them."""

    rows: DataFrame

    def _point(self, df: DataFrame) -> Column:
        x = as_array(df, "features")
        if self.metric != "cosine":
            return x
        # On unit vectors, cosine distance is half the squared distance.
        norm = F.sqrt(dot(x, x))
        return F.transform(x, lambda v: F.when(norm > 0, v / norm).otherwise(F.lit(0.0)))

    def transform(self, df: DataFrame, id_column: str | None = None) -> DataFrame:
        if id_column is None:
            df, id_column = cut(df.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"
        queries = df.select(F.col(id_column).alias("qid"), self._point(df).alias("x"))
        found = nearest_neighbours(queries, self.rows, self.k, self.p)
        distance = F.col("distance")
        if self.metric == "cosine":
            distance = distance * distance / 2.0
        # at most k per query
        near = found.groupBy("qid").agg(F.collect_list(F.struct(distance.alias("d"), "label")).alias("near"))
        weighted = F.col("near")
        exact = F.exists(weighted, lambda v: v["d"] == 0)
        if self.weights == "distance":
            weight = lambda v: F.when(exact, (v["d"] == 0).cast("double")).otherwise(1.0 / v["d"])
        else:
            weight = lambda v: F.lit(1.0)
        pairs = F.transform(weighted, lambda v: F.struct(weight(v).alias("w"), v["label"].alias("label")))
        summed = lambda values, f: F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))
        if self.task == "regression":
            value = summed(pairs, lambda v: v["w"] * v["label"]) / summed(pairs, lambda v: v["w"])
        else:
            labels = F.array_distinct(F.transform(pairs, lambda v: v["label"]))
            votes = F.transform(labels, lambda l: F.struct(
                (-summed(F.filter(pairs, lambda v: v["label"] == l), lambda v: v["w"])).alias("w"), l.alias("label")))
            value = F.array_min(votes)["label"]
        predicted = near.select(F.col("qid").alias(id_column), value.alias("prediction"))
        out = df.join(predicted, id_column)
        return out.drop("_row") if id_column == "_row" else out

    def save(self, path: str) -> None:
        super().save(path)
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, params: dict) -> "NeighboursModel":
        model = cls(**params)
        model.rows = spark.read.parquet(f"{path}/rows")
        return model


def _fit(df: DataFrame, hyper: dict, task: str):
    metric = hyper.pop("metric", "minkowski")
    if metric not in ("cosine", "minkowski", *POWERS):
        raise ValueError(f"unsupported metric: {metric}")
    p = float(hyper.pop("p", 2) or 2)
    model = NeighboursModel(
        task=task, k=int(hyper.pop("n_neighbors", 5)), weights=hyper.pop("weights", "uniform"),
        metric=metric, p=2.0 if metric == "cosine" else POWERS.get(metric, p),
    )
    key = hyper.pop("id_column", None)
    ident = F.col(key) if key else F.monotonically_increasing_id()
    model.rows = cut(df.select(ident.alias("rid"), model._point(df).alias("x"), F.col("label").cast("double").alias("label")), "neighbours")
    return model, []


def classify(df: DataFrame, hyper: dict):
    return _fit(df, hyper, "classification")


def regress(df: DataFrame, hyper: dict):
    return _fit(df, hyper, "regression")
