"""Linear and logistic regression with the documented penalty scales."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.blocks import matrix
from tablewright.functions.vectors import as_array, constant, dot
from tablewright.learners.base import TableModel, take


class LinearTableModel(TableModel):
    """prediction = intercept + coefficients . features"""

    def transform(self, df: DataFrame) -> DataFrame:
        weights = constant(list(self.coefficients), "array<double>")
        return df.withColumn("prediction", dot(as_array(df, "features"), weights) + F.lit(float(self.intercept)))


def moments(df: DataFrame, extra: str = "label") -> tuple[float, np.ndarray]:
    """Row count and cross products of (1, features, label), summed where the rows lie."""
    width = len(df.select("features").first()[0]) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            x = matrix(pdf["x"], width - 2)
            full = np.column_stack([np.ones(len(x)), x, pdf["y"].to_numpy()])
            total += full.T @ full
        i, j = np.divmod(np.arange(width * width), width)
        yield pd.DataFrame({"i": i, "j": j, "v": total.ravel()})

    rows = df.select(as_array(df, "features").alias("x"), F.col(extra).cast("double").alias("y"))
    sums = rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((width, width))
    for r in sums:  # (features + 2) squared rows
        out[r.i, r.j] = r.v
    return out[0, 0], out


def _nonnegative(df: DataFrame, alpha: float, l1_ratio: float, fit_intercept: bool, max_iter: int, tol: float):
    """Coordinate descent on the centred Gram matrix, coefficients kept at or above zero."""
    n, m = moments(df)
    mean = m[0, 1:] / n if fit_intercept else np.zeros(m.shape[0] - 1)
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    gram, target = cov[:-1, :-1], cov[:-1, -1]
    w = np.zeros(len(target))
    for _ in range(max_iter):
        change = 0.0
        for j in range(len(w)):
            scale = gram[j, j] + alpha * (1 - l1_ratio)
            rho = target[j] - gram[j] @ w + gram[j, j] * w[j]
            new = max(0.0, rho - alpha * l1_ratio) / scale if scale > 0 else 0.0
            change, w[j] = max(change, abs(new - w[j])), new
        if change <= tol:
            break
    return LinearTableModel(coefficients=w.tolist(), intercept=float(mean[-1] - mean[:-1] @ w)), []


def _linear(df: DataFrame, hyper: dict, alpha: float, l1_ratio: float, per_row: bool):
    """``per_row``: the squared penalty is not divided by the row count (ridge)."""
    intercept = hyper.pop("fit_intercept", True)
    max_iter, tol = int(hyper.pop("max_iter", None) or 1000), float(hyper.pop("tol", None) or 1e-10)
    facts = df.agg(F.count("label").alias("n"), F.stddev_samp(F.col("label").cast("double")).alias("s")).first()
    if per_row:
        alpha = alpha / facts.n
    if hyper.pop("positive", False):
        return _nonnegative(df, alpha, l1_ratio, intercept, max_iter, min(tol, 1e-10))
    # Spark measures the squared penalty in units of the label's deviation.
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * (facts.s or 1.0)
    reg = l1 + l2
    model = LinearRegression(
        regParam=reg, elasticNetParam=l1 / reg if reg else 0.0, standardization=False, fitIntercept=intercept,
        maxIter=max_iter, tol=min(tol, 1e-10), solver="normal" if reg == 0 else "l-bfgs",
    ).fit(df)
    return model, list(model.summary.objectiveHistory) if model.hasSummary else []


def ols(df: DataFrame, hyper: dict):
    return _linear(df, hyper, 0.0, 0.0, False)


def ridge(df: DataFrame, hyper: dict):
    return _linear(df, hyper, float(hyper.pop("alpha", 1.0)), 0.0, True)


def lasso(df: DataFrame, hyper: dict):
    return _linear(df, hyper, float(hyper.pop("alpha", 1.0)), 1.0, False)


def elastic_net(df: DataFrame, hyper: dict):
    return _linear(df, hyper, float(hyper.pop("alpha", 1.0)), float(hyper.pop("l1_ratio", 0.5)), False)


def class_weights(df: DataFrame, choice) -> DataFrame:
    """Add ``weight``: 'balanced' = n / (classes * own count), or a given weight per class."""
    if not choice:
        return df.withColumn("weight", F.lit(1.0))
    if choice == "balanced":
        counts = df.groupBy("label").count().collect()  # one row per class
        total = sum(r["count"] for r in counts)
        choice = {r.label: total / (len(counts) * r["count"]) for r in counts}
    pairs = [F.lit(float(v)) for item in choice.items() for v in item]
    return df.withColumn("weight", F.coalesce(F.element_at(F.create_map(*pairs), F.col("label").cast("double")), F.lit(1.0)))


def logistic(df: DataFrame, hyper: dict):
    """Penalty ``1 / (n C)``; ``regularization`` is the inverse of C."""
    inverse = hyper.pop("regularization", None)
    c = 1.0 / inverse if inverse else float(hyper.pop("C", 1.0))
    penalty = hyper.pop("penalty", "l2")
    weighted = class_weights(df, hyper.pop("class_weight", None))
    n = weighted.agg(F.sum("weight")).first()[0]
    base = LogisticRegression(
        regParam=0.0 if penalty in (None, "none") else 1.0 / (n * c), elasticNetParam=1.0 if penalty == "l1" else 0.0,
        standardization=False, weightCol="weight", **take(hyper, fit_intercept="fitIntercept", max_iter="maxIter", tol="tol"),
    )
    many = df.select("label").distinct().limit(3).count() > 2
    if hyper.pop("multi_class", "ovr") == "ovr" and many:
        return OneVsRest(classifier=base, weightCol="weight").fit(weighted), []
    model = base.fit(weighted)
    return model, list(model.summary.objectiveHistory) if model.hasSummary else []
