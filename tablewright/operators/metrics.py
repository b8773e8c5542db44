"""Scores of predictions and of cluster labels, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.vectors import nearest


def _pair(label: str, prediction: str) -> tuple[Column, Column]:
    return F.col(label), F.col(prediction)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(mse, r2) in one pass."""
    y, p = (c.cast("double") for c in _pair(label, prediction))
    error = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    r2 = F.when(spread > 0, 1.0 - error / spread).when(error == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return df.agg((error / F.count(y)).alias("mse"), r2.alias("r2"))


def _per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, tp, support, predicted) from the confusion counts."""
    confusion = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("l") == F.col("p")
    sides = confusion.select(F.inline(F.array(
        F.struct(F.col("l").alias("c"), F.when(same, F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )))
    return sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                  F.sum("predicted").alias("predicted"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(accuracy, precision, recall, f1): support-weighted; an empty denominator counts as 0."""
    typed = df.select(F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p"))
    per = _per_class(typed, "l", "p")
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    weighted = lambda v: F.sum(v * support) / F.sum(support)
    return per.agg(
        (F.sum(tp) / F.sum(support)).alias("accuracy"),
        weighted(safe(tp, predicted)).alias("precision"),
        weighted(safe(tp, support)).alias("recall"),
        weighted(safe(2.0 * tp, support + predicted)).alias("f1"),
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = _pair(label, prediction)
    return df.agg(F.avg((y == p).cast("double")).alias("accuracy"))


def inertia(df: DataFrame, features: Column, centres) -> DataFrame:
    """Sum of squared distances to the nearest of the given centres."""
    return df.agg(F.sum(nearest(features, centres)["d"]).alias("inertia"))


def cluster_counts(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(clusters, noise): labels of 0 and above count as clusters, -1 as noise."""
    l = F.col(label)
    return df.agg(F.count_distinct(F.when(l >= 0, l)).alias("clusters"), F.count_if(l == -1).alias("noise"))
