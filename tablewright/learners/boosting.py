"""AdaBoost: re-weighted rounds of small Spark trees."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.learners.base import TableModel
from tablewright.runtime import cut

# Rounds between two written copies of the weights.
CUT_EVERY = 5
_SCRATCH = ("rawPrediction", "probability")


def _predict(model, df: DataFrame, name: str) -> DataFrame:
    out = model.transform(df)
    return out.withColumnRenamed("prediction", name).drop(*_SCRATCH)


class BoostedModel(TableModel):
    trees: list
    tree_kind: type

    def _scored(self, df: DataFrame) -> DataFrame:
        for i, tree in enumerate(self.trees):
            df = _predict(tree, df, f"_p{i}")
        return df

    def _drop(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"_p{i}" for i in range(len(self.trees))])

    def save(self, path: str) -> None:
        super().save(path)
        for i, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree{i}")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, params: dict) -> "BoostedModel":
        model = cls(**params)
        model.trees = [cls.tree_kind.load(f"{path}/tree{i}") for i in range(len(params["alphas"]))]
        return model


class BoostedClassifier(BoostedModel):
    tree_kind = DecisionTreeClassificationModel

    def transform(self, df: DataFrame) -> DataFrame:
        votes = F.array(*[
            F.struct((-sum((F.when(F.col(f"_p{i}") == c, F.lit(a)).otherwise(F.lit(0.0)) for i, a in enumerate(self.alphas)),
                           F.lit(0.0))).alias("v"), F.lit(c).alias("c"))
            for c in self.classes
        ])
        return self._drop(self._scored(df).withColumn("prediction", F.array_min(votes)["c"]))


class BoostedRegressor(BoostedModel):
    tree_kind = DecisionTreeRegressionModel

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees."""
        ordered = F.array_sort(F.array(*[
            F.struct(F.col(f"_p{i}").alias("p"), F.lit(float(a)).alias("a")) for i, a in enumerate(self.alphas)
        ]))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p"))
        half = F.lit(sum(self.alphas) / 2.0)
        median = F.aggregate(ordered, start, lambda acc, t: F.struct(
            (acc["s"] + t["a"]).alias("s"),
            F.coalesce(acc["p"], F.when(acc["s"] + t["a"] >= half, t["p"])).alias("p"),
        ))["p"]
        return self._drop(self._scored(df).withColumn("prediction", median))


def _start(df: DataFrame) -> tuple[DataFrame, int]:
    rows = cut(df.select("features", F.col("label").cast("double").alias("label"), F.lit(1.0).alias("w")), "boost")
    return rows, rows.count()


def _depth(hyper: dict, default: int) -> int:
    estimator = hyper.pop("estimator", None)
    return int(hyper.pop("max_depth", None) or getattr(estimator, "max_depth", None) or default)


def classify(df: DataFrame, hyper: dict):
    """SAMME: a tree's vote grows with log((1 - error) / error) + log(classes - 1)."""
    rounds, rate = int(hyper.pop("n_estimators", 50)), float(hyper.pop("learning_rate", 1.0))
    seed, depth = int(hyper.pop("random_state", None) or 42), _depth(hyper, 1)
    bins = int(hyper.pop("max_bins", 32))
    rows, n = _start(df)
    classes = sorted(r.label for r in rows.select("label").distinct().collect())  # one row per class
    model = BoostedClassifier(classes=classes, alphas=[])
    model.trees, errors = [], []
    for i in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=depth, maxBins=bins, weightCol="w", seed=seed).fit(rows)
        scored = _predict(tree, rows, "_p")
        miss = (F.col("_p") != F.col("label")).cast("double")
        total = scored.agg(F.sum("w").alias("w"), F.sum(F.col("w") * miss).alias("e")).first()
        error = total.e / total.w
        if error >= 1 - 1 / len(classes):
            break
        alpha = 1.0 if error <= 0 else rate * (math.log((1 - error) / error) + math.log(len(classes) - 1))
        model.trees.append(tree)
        model.params["alphas"].append(alpha)
        errors.append(error)
        if error <= 0:
            break
        # weights keep the sum n, which Spark's trees expect to be of ordinary size
        scale = n / (total.w + total.e * (math.exp(alpha) - 1))
        rows = scored.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * miss) * F.lit(scale)).drop("_p")
        if i % CUT_EVERY == CUT_EVERY - 1:
            rows = cut(rows, "boost")
    return model, errors


def _loss(name: str) -> "callable":
    shapes = {
        "linear": lambda e: e,
        "square": lambda e: e * e,
        "exponential": lambda e: 1.0 - F.exp(-e),
    }
    return shapes[name]


def regress(df: DataFrame, hyper: dict):
    """AdaBoost.R2; trees see the weights directly instead of a weighted resample."""
    rounds, rate = int(hyper.pop("n_estimators", 50)), float(hyper.pop("learning_rate", 1.0))
    seed, depth, loss = int(hyper.pop("random_state", None) or 42), _depth(hyper, 3), _loss(hyper.pop("loss", "linear"))
    bins = int(hyper.pop("max_bins", 32))
    rows, n = _start(df)
    model = BoostedRegressor(alphas=[])
    model.trees, errors = [], []
    for i in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=depth, maxBins=bins, weightCol="w", seed=seed).fit(rows)
        scored = _predict(tree, rows, "_p")
        gap = F.abs(F.col("label") - F.col("_p"))
        largest = scored.agg(F.max(gap)).first()[0]
        model.trees.append(tree)
        if not largest:
            model.params["alphas"].append(1.0)
            break
        share: Column = loss(gap / F.lit(largest))
        total = scored.agg(F.sum("w").alias("w"), F.sum(F.col("w") * share).alias("e")).first()
        error = total.e / total.w
        if error >= 0.5:
            if len(model.trees) > 1:
                model.trees.pop()
            else:
                model.params["alphas"].append(1.0)
            break
        beta = error / (1 - error)
        model.params["alphas"].append(rate * math.log(1 / beta))
        errors.append(error)
        raised = scored.withColumn("w", F.col("w") * F.pow(F.lit(beta), (1.0 - share) * F.lit(rate))).drop("_p")
        if i % CUT_EVERY == CUT_EVERY - 1:
            raised = cut(raised, "boost")
        scale = n / raised.agg(F.sum("w")).first()[0]
        rows = raised.withColumn("w", F.col("w") * F.lit(scale))
    return model, errors
