"""The synchronous training job: quick features, split, fit, score, record."""

from __future__ import annotations

import time
import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from tablewright.learners.catalogue import Trained, train
from tablewright.operators.features import fit_pca, quick_features
from tablewright.operators.split import train_test
from tablewright.sources.registry import append_model

# The model types a training request may name, and their settings.
MODEL_TYPES = {
    "linear_regression": {},
    "logistic_regression": {"max_iter": 200, "regularization": 0.1},
    "decision_tree": {},
    "random_forest": {},
    "kmeans": {"n_clusters": 3},
    "pca": {"n_components": 2},
    "mlp": {"learningRate": 0.01, "max_iter": 200},
}
_ACCEPTED = {"logistic_regression": ("regularization",), "kmeans": ("n_clusters",), "pca": ("n_components",), "mlp": ("learningRate",)}
UNSUPERVISED = ("kmeans", "pca")
TEST_PERCENTAGE = 20


def train_model(model_type: str, train_df: DataFrame, test_df: DataFrame | None, hyperparameters: dict | None = None, **more) -> Trained:
    """One of ``MODEL_TYPES`` with the request's settings; scores under the request's names."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unsupported model type: {model_type}")
    given = {k: v for k, v in (hyperparameters or {}).items() if k in _ACCEPTED.get(model_type, ())}
    settings = {**MODEL_TYPES[model_type], **given, **more}
    if model_type == "pca":
        started = time.perf_counter()
        model, ratios = fit_pca(train_df, k=int(settings["n_components"]))
        return Trained("pca", model, {"explained_variance": sum(ratios)}, time.perf_counter() - started, [sum(ratios)])
    fitted = train(model_type, train_df, test_df, **settings)
    names = {"test_mse": "mse", "test_r2": "r2", "test_accuracy": "accuracy", "train_inertia": "inertia"}
    fitted.metrics = {names[k]: v for k, v in fitted.metrics.items() if k in names}
    return fitted


def train_job(df: DataFrame, model_type: str, target: str | None = None, hyperparameters: dict | None = None,
              key: list[str] | None = None, dataset_id: str = "", registry: str | None = None) -> Trained:
    """Train on a raw table. ``target`` is required except for kmeans and pca, which use every row.

    With ``key`` those columns decide the split and are not features.
    """
    if model_type not in MODEL_TYPES:
        raise ValueError(f"unsupported model type: {model_type}")
    if not target and model_type not in UNSUPERVISED:
        raise ValueError("a target column is required")
    key = key or []
    table = df.withColumns({f"_key{i}": df[k].cast("string") for i, k in enumerate(key)}).drop(*key)
    hidden = [c for c in table.columns if c.startswith("_key")]
    ready = quick_features(table, target or None, keep=hidden)
    names = [c for c in ready.columns if c not in hidden and c != "label"]
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    kept = [c for c in ("features", "label") if c in assembled.columns]
    if model_type in UNSUPERVISED:
        left, right = assembled.select(*kept), None
    else:
        left, right = train_test(assembled, hidden or names, TEST_PERCENTAGE)
        left, right = left.select(*kept), right.select(*kept)
    left = left.persist()
    try:
        fitted = train_model(model_type, left, right, hyperparameters)
    finally:
        left.unpersist()
    if registry:
        append_model(df.sparkSession, registry, dataset_id, fitted, uuid.uuid4().hex)
    return fitted

