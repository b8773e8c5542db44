"""Decision trees, forests, gradient boosting and the perceptron, all Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from tablewright.learners.base import take
from tablewright.learners.linear import class_weights

# Impurity names.
IMPURITY = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy", "squared_error": "variance", None: None}
# The deepest tree that Spark grows.
DEEPEST = 30


def _tree(hyper: dict) -> dict:
    depth = hyper.pop("max_depth", None)
    out = take(hyper, min_samples_leaf="minInstancesPerNode", min_impurity_decrease="minInfoGain",
               min_weight_fraction_leaf="minWeightFractionPerNode", random_state="seed", max_bins="maxBins")
    if depth is not None and int(depth) > DEEPEST:
        raise ValueError(f"trees are at most {DEEPEST} deep, not {depth}")
    out["maxDepth"] = DEEPEST if depth is None else int(depth)
    impurity = IMPURITY.get(hyper.pop("criterion", None))
    return {**out, "impurity": impurity} if impurity else out


def _forest(hyper: dict, features: str) -> dict:
    out = take(hyper, n_estimators="numTrees", max_samples="subsamplingRate", bootstrap="bootstrap")
    out.setdefault("numTrees", 100)
    choice = hyper.pop("max_features", features)
    out["featureSubsetStrategy"] = {None: "all", 1.0: "all"}.get(choice, str(choice))
    return out


def tree_classifier(df: DataFrame, hyper: dict):
    """One tree over all features; a feature subset per split is a forest's setting."""
    data = class_weights(df, hyper.pop("class_weight", None))
    return DecisionTreeClassifier(weightCol="weight", **_tree(hyper)).fit(data), []


def forest_classifier(df: DataFrame, hyper: dict):
    data = class_weights(df, hyper.pop("class_weight", None))
    return RandomForestClassifier(weightCol="weight", **_forest(hyper, "sqrt"), **_tree(hyper)).fit(data), []


def tree_regressor(df: DataFrame, hyper: dict):
    return DecisionTreeRegressor(**_tree(hyper)).fit(df), []


def forest_regressor(df: DataFrame, hyper: dict):
    return RandomForestRegressor(**_forest(hyper, "all"), **_tree(hyper)).fit(df), []


def gbt_classifier(df: DataFrame, hyper: dict):
    """Two classes directly, more by one-versus-rest."""
    hyper.setdefault("max_depth", 3)
    tree = _tree(hyper)
    tree.pop("impurity", None)
    options = take(hyper, learning_rate="stepSize", n_estimators="maxIter", subsample="subsamplingRate")
    options = {"stepSize": 0.1, "maxIter": 100, **options}
    choice = hyper.pop("max_features", None)
    if choice is not None:
        options["featureSubsetStrategy"] = str(choice)
    if hyper.pop("n_iter_no_change", None):
        share = float(hyper.pop("validation_fraction", 0.1))
        part = F.pmod(F.xxhash64("features", "label"), F.lit(10_000))
        df = df.withColumn("_validate", part < F.lit(int(share * 10_000)))
        options.update(validationIndicatorCol="_validate", validationTol=float(hyper.pop("tol", 1e-4)))
    base = GBTClassifier(**options, **tree)
    if df.select("label").distinct().limit(3).count() > 2:
        return OneVsRest(classifier=base).fit(df), []
    return base.fit(df), []


def perceptron(df: DataFrame, hyper: dict):
    """One hidden layer of 100; labels are 0, 1, ..., k - 1."""
    width = len(df.select("features").first()[0])
    classes = int(df.agg(F.max("label")).first()[0]) + 1
    hidden = [int(h) for h in hyper.pop("hidden_layer_sizes", (100,))]
    step = hyper.pop("learning_rate_init", None) or hyper.pop("learningRate", None) or 0.01
    model = MultilayerPerceptronClassifier(
        layers=[width, *hidden, max(classes, 2)], maxIter=int(hyper.pop("max_iter", 200)), stepSize=float(step),
        seed=int(hyper.pop("random_state", None) or 42),
    ).fit(df)
    return model, [float(v) for v in model.summary().objectiveHistory]
