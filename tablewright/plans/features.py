"""The whole feature job: fit, transform, split, persist."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.features import FeatureModel, fit_features, label_encode
from tablewright.operators.split import is_test
from tablewright.spec import DatasetSpec


def build_features(
    df: DataFrame, spec: DatasetSpec, fit_on: str = "all", path: str | None = None
) -> tuple[DataFrame, DataFrame, FeatureModel]:
    """(train, test, model) with ``features`` and, if there is a target, ``label``.

    ``fit_on='train'`` learns statistics from the training side only.
    """
    target = spec.target_column or None
    side = is_test(list(spec.row_key) or df.columns, spec.test_dataset_percentage)
    marked = df.withColumn("_test", side)
    model = fit_features(marked.where(~F.col("_test")) if fit_on == "train" else marked, spec)
    if path:
        model.save(path)
    out = model.transform(marked)
    if target:
        if dict(df.dtypes)[target] == "string":
            out = label_encode(out, [target])
        out = out.withColumn(target, F.col(f"`{target}`").cast("double")).withColumnRenamed(target, "label")
    return out.where(~F.col("_test")).drop("_test"), out.where("_test").drop("_test"), model
