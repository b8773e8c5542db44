"""One question end to end: how well does a cleaned, scaled table predict its target?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.catalogue.inputs import lines
from tablewright.learners.catalogue import train
from tablewright.plans.clean import clean
from tablewright.plans.features import build_features
from tablewright.runtime import cut
from tablewright.spec import DatasetSpec

SPEC = DatasetSpec(
    types={"k": "str", "qty": "float", "disc": "float", "tax": "float", "flag": "category", "y": "float"},
    fill_empty_rows_using="median", target_column="y", row_key=("k",), test_dataset_percentage=30,
)
# The row key identifies rows; it is not a feature.
FEATURE_SPEC = DatasetSpec(**{**SPEC.__dict__, "types": {c: t for c, t in SPEC.types.items() if c != "k"}})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inject gaps, clean, build features, split, fit a linear model, report its scores."""
    raw = lines(spark, sf_dir).selectExpr(
        "k", "case when hash(k) % 7 = 0 then null else cast(qty as string) end as qty", "disc", "tax", "flag", "y")
    ready = cut(clean(raw, SPEC, keep_typed=True), "clean")
    train_df, test_df, _ = build_features(ready, FEATURE_SPEC)
    sides = [cut(side.select("features", "label"), "side") for side in (train_df, test_df)]
    fitted = train("linear_regression", *sides)
    rows = [(name, float(value)) for name, value in sorted(fitted.metrics.items())]
    return spark.createDataFrame(rows, "metric string, value double")
