"""Support vector classification and regression."""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.blocks import matrix
from tablewright.functions.vectors import as_array
from tablewright.learners.base import TableModel, load_model, save_model, take
from tablewright.learners.linear import LinearTableModel, class_weights

RANDOM_FEATURES = 256
KERNELS = ("linear", "rbf", "poly")


class KernelMap(TableModel):
    """Explicit features of a kernel: random Fourier features (Rahimi & Recht 2007) or a polynomial."""

    def transform(self, df: DataFrame) -> DataFrame:
        if self.kernel == "linear":
            return df
        if self.kernel == "poly":
            scaled = F.transform(as_array(df, "features"), lambda v: v * F.lit(math.sqrt(self.gamma)))
            extended = F.concat(scaled, F.array(F.lit(math.sqrt(self.coef0)))) if self.coef0 > 0 else scaled
            expand = PolynomialExpansion(degree=self.degree, inputCol="_scaled", outputCol="_mapped")
            out = expand.transform(df.withColumn("_scaled", array_to_vector(extended)))
            return out.drop("features", "_scaled").withColumnRenamed("_mapped", "features")
        width, size = self.width, self.size
        random = np.random.default_rng(self.seed)
        weights = random.normal(0.0, math.sqrt(2 * self.gamma), (width, size))
        shift = random.uniform(0, 2 * math.pi, size)

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(matrix(x, width) @ weights + shift)))

        return df.withColumn("features", array_to_vector(project(as_array(df, "features"))))


def _kernel_map(df: DataFrame, hyper: dict, default: str) -> KernelMap:
    kernel = hyper.pop("kernel", default)
    if kernel not in KERNELS:
        raise ValueError(f"unsupported kernel {kernel!r}: choose one of {', '.join(KERNELS)}")
    gamma, width = hyper.pop("gamma", "scale"), len(df.select("features").first()[0])
    if gamma == "auto":
        gamma = 1.0 / width
    elif gamma == "scale":
        spread = df.select(F.explode(as_array(df, "features")).alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (width * spread) if spread else 1.0
    return KernelMap(
        kernel=kernel, gamma=float(gamma), width=width, size=int(hyper.pop("random_features", RANDOM_FEATURES)),
        degree=int(hyper.pop("degree", 3)), coef0=float(hyper.pop("coef0", 0.0)), seed=int(hyper.pop("random_state", None) or 42),
    )


class MarginModel(TableModel):
    """A kernel map followed by a linear model on the mapped features."""

    kernel_map: KernelMap
    inner: object

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = self.kernel_map.transform(df.withColumn("_given", F.col("features")))
        out = self.inner.transform(mapped).drop("features", "rawPrediction")
        return out.withColumnRenamed("_given", "features")

    def save(self, path: str) -> None:
        super().save(path)
        save_model(self.kernel_map, f"{path}/map")
        save_model(self.inner, f"{path}/inner")

    @classmethod
    def restore(cls, spark, path: str, params: dict) -> "MarginModel":
        model = cls(**params)
        model.kernel_map, model.inner = load_model(spark, f"{path}/map"), load_model(spark, f"{path}/inner")
        return model


# Steps of a solver that is to stop by its tolerance alone.
UNLIMITED = 1_000_000


def classify(df: DataFrame, hyper: dict):
    """Hinge loss with penalty 1 / (n C); more than two classes by one-versus-rest."""
    kernel = _kernel_map(df, hyper, "rbf")
    mapped = class_weights(kernel.transform(df), hyper.pop("class_weight", None))
    n = mapped.agg(F.sum("weight")).first()[0]
    options = take(hyper, tol="tol", max_iter="maxIter")
    if options.get("maxIter", -1) < 0:
        options["maxIter"] = UNLIMITED
    base = LinearSVC(regParam=1.0 / (n * float(hyper.pop("C", 1.0))), standardization=False, weightCol="weight", **options)
    many = df.select("label").distinct().limit(3).count() > 2
    inner = OneVsRest(classifier=base, weightCol="weight").fit(mapped) if many else base.fit(mapped)
    model = MarginModel()
    model.kernel_map, model.inner = kernel, inner
    return model, []


def _loss_pass(rows: DataFrame, width: int, weights: np.ndarray, bias: float, epsilon: float, soft: float):
    """Loss and gradient of the smoothed insensitive loss, one partial sum per partition."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, grad = 0.0, np.zeros(width + 1)
        for pdf in batches:
            x, w = matrix(pdf["x"], width), pdf["w"].to_numpy()
            r = x @ weights + bias - pdf["y"].to_numpy()
            over = np.maximum(np.abs(r) - epsilon, 0.0)
            loss += (w * np.where(over < soft, over**2 / (2 * soft), over - soft / 2)).sum()
            slope = w * np.sign(r) * np.minimum(over / soft, 1.0)
            grad += np.append(x.T @ slope, slope.sum())
        yield pd.DataFrame({"loss": [loss], "g": [grad]})

    parts = rows.mapInPandas(partial, "loss double, g array<double>")
    total = parts.agg(F.sum("loss"), *[F.sum(F.col("g")[j]) for j in range(width + 1)]).first()
    return total[0], np.array(total[1:])


def regress(df: DataFrame, hyper: dict):
    """Epsilon-insensitive regression: half squared norm + C times the loss, by L-BFGS.

    The loss is smoothed over ``soft`` and re-solved with a smaller one; every
    step is one pass over the rows, of which equal ones act as one with a weight, and only
    the weights live on the driver.
    """
    kernel = _kernel_map(df, hyper, "rbf")
    c, epsilon = float(hyper.pop("C", 1.0)), float(hyper.pop("epsilon", 0.1))
    tol, steps = float(hyper.pop("tol", 1e-3)), int(hyper.pop("max_iter", -1))
    steps = UNLIMITED if steps < 0 else steps
    facts = df.agg(F.avg(F.col("label").cast("double")).alias("m"), F.stddev_pop(F.col("label").cast("double")).alias("s"), F.count("label").alias("n")).first()
    given = df.select(as_array(df, "features").alias("features"), F.col("label").cast("double").alias("y"))
    mapped = kernel.transform(given.groupBy("features", "y").agg(F.count(F.lit(1)).cast("double").alias("w")))
    rows = mapped.select(as_array(mapped, "features").alias("x"), "y", "w").persist()
    width = len(rows.first().x)
    theta, history = np.append(np.zeros(width), facts.m), []
    for soft in (max(facts.s or 1.0, 1e-6) * 0.1, max(facts.s or 1.0, 1e-6) * 0.01):
        def evaluate(t):
            loss, grad = _loss_pass(rows, width, t[:-1], t[-1], epsilon, soft)
            value = 0.5 * t[:-1] @ t[:-1] + c * loss
            return value / facts.n, (c * grad + np.append(t[:-1], 0.0)) / facts.n

        theta, values = _minimise(evaluate, theta, steps, tol)
        history += values
    rows.unpersist()
    inner = LinearTableModel(coefficients=theta[:-1].tolist(), intercept=float(theta[-1]))
    model = MarginModel()
    model.kernel_map, model.inner = kernel, inner
    return model, history


def _minimise(evaluate, theta: np.ndarray, steps: int, tol: float, memory: int = 8):
    """Limited-memory BFGS with a backtracking line search."""
    value, grad = evaluate(theta)
    pairs, values = [], [float(value)]
    for _ in range(steps):
        direction, kept = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            kept.append(a)
            direction -= a * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(direction))
        for (s, y), a in zip(pairs, reversed(kept)):
            direction += s * (a - (y @ direction) / (s @ y))
        step, slope = 1.0, -(grad @ direction)
        while step > 1e-6:
            new = theta - step * direction
            new_value, new_grad = evaluate(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-12:
            pairs = (pairs + [(s, y)])[-memory:]
        done = abs(value - new_value) <= tol * 1e-3 * max(1.0, abs(value))
        theta, value, grad = new, new_value, new_grad
        values.append(float(value))
        if done:
            break
    return theta, values
