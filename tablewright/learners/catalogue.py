"""Every trainer by name, and one call that fits, scores and times it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablewright.clustering import centres
from tablewright.clustering.density import dbscan
from tablewright.clustering.hierarchy import agglomerative, birch
from tablewright.clustering.modes import mean_shift
from tablewright.clustering.spectral import spectral
from tablewright.functions.vectors import as_array
from tablewright.learners.base import RelabelledModel
from tablewright.learners import bayes, boosting, linear, margins, neighbours, trees
from tablewright.operators import metrics
from tablewright.operators.silhouette import silhouette
from tablewright.runtime import cut

REGRESSORS = {
    "linear_regression": linear.ols, "ridge": linear.ridge, "lasso": linear.lasso, "elastic_net": linear.elastic_net,
    "svr": margins.regress, "ada_boost_regressor": boosting.regress, "decision_tree_regressor": trees.tree_regressor,
    "random_forest_regressor": trees.forest_regressor, "knn_regressor": neighbours.regress,
}
CLASSIFIERS = {
    "logistic_regression": linear.logistic, "decision_tree": trees.tree_classifier, "random_forest": trees.forest_classifier,
    "gradient_boosting": trees.gbt_classifier, "svc": margins.classify, "knn_classifier": neighbours.classify,
    "ada_boost_classifier": boosting.classify, "mlp": trees.perceptron, "gaussian_nb": bayes.gaussian,
    "multinomial_nb": bayes.multinomial, "bernoulli_nb": bayes.bernoulli, "complement_nb": bayes.complement,
    "categorical_nb": bayes.categorical,
}
CENTRE_CLUSTERERS = {"kmeans": centres.kmeans, "minibatch_kmeans": centres.minibatch_kmeans}
LABEL_CLUSTERERS = {"agglomerative": agglomerative, "birch": birch, "mean_shift": mean_shift, "spectral": spectral, "dbscan": dbscan}
# Parameters each label clusterer takes; others are reported as ignored.
_CLUSTER_PARAMETERS = {
    "agglomerative": ("n_clusters", "linkage", "metric", "distance_threshold"),
    "birch": ("threshold", "n_clusters"),
    "mean_shift": ("bandwidth", "min_bin_freq", "cluster_all", "max_iter"),
    "spectral": ("n_clusters", "n_components", "gamma", "affinity", "n_neighbors", "n_init"),
    "dbscan": ("eps", "min_samples", "metric", "p"),
}
# Parameters for which None is a choice and not the default.
_NONE_COUNTS = ("max_features", "binarize", "penalty")


@dataclass
class Trained:
    """A fitted model with its scores; ``labels`` holds cluster labels where there is no model."""

    name: str
    model: object
    metrics: dict[str, float | None]
    train_time: float
    progress: list[float] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)
    labels: DataFrame | None = None


def cluster_score(df: DataFrame, features, label: str) -> dict[str, float | None]:
    """The plain-distance silhouette, at any size; ``silhouette_squared`` is the linear one to ask for instead."""
    return {"silhouette": silhouette(df, features, label)}


def _fit_classes(fit, train: DataFrame, hyper: dict):
    """Fit on class numbers 0, 1, ..., k - 1 in the order of the labels, whatever these are."""
    classes = sorted(float(r.label) for r in train.where("label is not null").select("label").distinct().collect())  # one row per class
    if classes == [float(i) for i in range(len(classes))]:
        return fit(train, hyper)
    if isinstance(hyper.get("class_weight"), dict):
        hyper["class_weight"] = {float(classes.index(float(c))): w for c, w in hyper["class_weight"].items() if float(c) in classes}
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label").cast("double")) - 1
    model = RelabelledModel(classes=classes)
    model.inner, progress = fit(train.withColumn("label", place.cast("double")), hyper)
    return model, progress


def _supervised(name: str, fit, train: DataFrame, test: DataFrame | None, hyper: dict) -> Trained:
    rest = {k: v for k, v in hyper.items() if v is not None or k in _NONE_COUNTS}
    started = time.perf_counter()
    model, progress = _fit_classes(fit, train, rest) if name in CLASSIFIERS else fit(train, rest)
    elapsed = time.perf_counter() - started
    scores: dict[str, float] = {}
    for side, df in (("train", train), ("test", test)):
        if df is None:
            continue
        predicted = model.transform(df)
        if name in REGRESSORS:
            row = metrics.regression_metrics(predicted).first()
            scores |= {f"{side}_mse": row.mse, f"{side}_r2": row.r2}
        else:
            row = metrics.classification_metrics(predicted).first()
            scores[f"{side}_accuracy"] = row.accuracy
            if side == "test":
                scores |= {"f1": row.f1, "precision": row.precision, "recall": row.recall}
    final = scores["train_mse" if name in REGRESSORS else "train_accuracy"]
    return Trained(name, model, scores, elapsed, [float(v) for v in progress] or [final], sorted(rest))


def _centres(name: str, fit, train: DataFrame, test: DataFrame | None, hyper: dict) -> Trained:
    rest = {k: v for k, v in hyper.items() if v is not None}
    started = time.perf_counter()
    model, progress = fit(train, rest)
    elapsed = time.perf_counter() - started
    points = model.clusterCenters() if hasattr(model, "clusterCenters") else model.centres
    scores: dict[str, float | None] = {}
    for side, df in (("train", train), ("test", test)):
        if df is not None:
            scores[f"{side}_inertia"] = metrics.inertia(df, as_array(df, "features"), points).first()[0]
    if name == "minibatch_kmeans":
        scores |= cluster_score(model.transform(train), "features", "prediction")
    return Trained(name, model, scores, elapsed, [float(v) for v in progress], sorted(rest))


def _labels(name: str, fit, train: DataFrame, test: DataFrame | None, hyper: dict) -> Trained:
    used = {k: v for k, v in hyper.items() if k in _CLUSTER_PARAMETERS[name] and v is not None}
    ignored = sorted(k for k in hyper if k not in _CLUSTER_PARAMETERS[name])
    sides = {"train": train, **({"test": test} if name == "dbscan" and test is not None else {})}
    scores: dict[str, float | None] = {}
    started, elapsed, kept = time.perf_counter(), 0.0, None
    for side, df in sides.items():
        rows = cut(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
        labelled = cut(rows.join(fit(rows, "_row", "features", **used), "_row"), "labelled")
        if side == "train":
            elapsed, kept = time.perf_counter() - started, labelled
        if name == "dbscan":
            row = metrics.cluster_counts(labelled).first()
            scores |= {f"{side}_clusters": float(row.clusters), f"{side}_noise": float(row.noise)}
            if row.clusters > 1:
                scores |= {f"{side}_{k}": v for k, v in cluster_score(labelled, "features", "cluster").items()}
        else:
            scores |= cluster_score(labelled, "features", "cluster")
    progress = [scores["train_clusters"]] if name == "dbscan" else [v for v in scores.values() if v is not None]
    return Trained(name, None, scores, elapsed, progress, ignored, kept.drop("_row"))


def train(name: str, train_df: DataFrame, test_df: DataFrame | None = None, **hyper) -> Trained:
    """Fit a trainer on (features, label) and score both sides; an unknown name is an error."""
    for kinds, run in ((REGRESSORS, _supervised), (CLASSIFIERS, _supervised), (CENTRE_CLUSTERERS, _centres), (LABEL_CLUSTERERS, _labels)):
        if name in kinds:
            return run(name, kinds[name], train_df, test_df, hyper)
    raise ValueError(f"unsupported model type: {name}")
