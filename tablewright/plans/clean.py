"""The whole cleaning job of one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.operators import cleaning
from tablewright.operators.profile import is_empty
from tablewright.runtime import cut
from tablewright.spec import DatasetSpec


def clean(df: DataFrame, spec: DatasetSpec, keep_typed: bool = False) -> DataFrame:
    """Enforce types, handle missing cells, remove duplicate rows, and the optional steps.

    Everything is one lazy plan with one shuffle; only column statistics are
    computed on the way. ``keep_typed`` writes the typed table once, so that the
    passes for the statistics read columns instead of parsing the source again.
    """
    typed = cleaning.enforce_types(df, spec)
    if keep_typed:
        typed = cut(typed, "typed")
    filled = cleaning.handle_nulls(typed, spec)
    rows = cleaning.remove_duplicates(filled) if spec.remove_duplicate else filled
    if spec.remove_highly_correlated_columns:
        numeric = [c for c, t in spec.declared(rows).items()
                   if t in ("int", "uint", "float") and c != spec.target_column]
        rows = cleaning.drop_correlated(rows, numeric)
    if spec.increase_the_size_of_dataset and spec.target_column:
        rows = cleaning.oversample(rows, spec.target_column, list(spec.row_key) or rows.columns).drop("copy")
    return rows


def clean_all(datasets: dict[str, tuple[DataFrame, DatasetSpec]], write) -> dict[str, str]:
    """Clean each dataset and hand it to ``write``; an empty one is left out, and one failure does not stop the others."""
    outcome = {}
    for name, (df, spec) in datasets.items():
        try:
            if is_empty(df):
                outcome[name] = "empty"
                continue
            write(name, clean(df, spec))
            outcome[name] = "done"
        except Exception as error:  # noqa: BLE001 - reported, the dataset stays queued
            outcome[name] = f"failed: {error}"
    return outcome
