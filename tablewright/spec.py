"""What a user declares about a table: column types and processing options."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any, Mapping

from pyspark.sql import DataFrame, functions as F, types as T

# The declared column types a dataset may use.
DECLARED_TYPES = (
    "int", "uint", "float", "bool", "str", "category", "date_time", "date",
    "time", "timedelta", "complex", "object",
)

# The declared types that feed each group of features.
NUMERIC_TYPES = ("float", "double", "int", "uint", "integer")
CATEGORICAL_TYPES = ("category", "object", "str")
DATETIME_TYPES = ("datetime", "date", "time")


@dataclass(frozen=True)
class DatasetSpec:
    """Declared types and options of one dataset, with the documented defaults."""

    types: Mapping[str, str] = field(default_factory=dict)
    fill_empty_rows_using: str = ""
    remove_duplicate: bool = True
    standardization_necessary: bool = True
    normalization_necessary: bool = False
    test_dataset_percentage: int = 30
    increase_the_size_of_dataset: bool = False
    fill_string_type_columns: bool = False
    dimensionality_reduction: bool = False
    target_column: str = ""
    remove_highly_correlated_columns: bool = False
    dataset_description: str = ""
    usage_of_each_column: Mapping[str, str] = field(default_factory=dict)
    what_user_wants_to_do: str = ""
    # Ours: order in which date texts are tried, value maps for bool and
    # category columns, the columns that identify a row, and the quirk switch.
    date_formats: tuple[str, ...] = ()
    value_maps: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    row_key: tuple[str, ...] = ()
    compat: bool = False

    @classmethod
    def from_row(cls, row: Any) -> "DatasetSpec":
        """Build a spec from a spec-table row or mapping; absent or null fields
        take their defaults."""
        given = row.asDict(recursive=True) if hasattr(row, "asDict") else dict(row)
        if "datatype_of_each_column" in given:
            given["types"] = given.pop("datatype_of_each_column")
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in known and v is not None})

    def fill_method(self) -> str:
        return self.fill_empty_rows_using or "mean"

    def declared(self, df: DataFrame) -> dict[str, str]:
        """Declared columns that exist in ``df``; all others pass through."""
        return {c: self.types[c] for c in df.columns if c in self.types}


# Feature group of each declared type; a type that is missing here feeds no feature.
FEATURE_GROUP = {
    **dict.fromkeys(NUMERIC_TYPES, "numeric"), **dict.fromkeys(CATEGORICAL_TYPES, "categorical"),
    **dict.fromkeys((*DATETIME_TYPES, "date_time"), "datetime"),
}


def route_columns(spec: DatasetSpec) -> tuple[list[str], list[str], list[str]]:
    """Names of the numeric, categorical and datetime features, without the target.

    ``spec.compat`` leaves ``date_time`` columns out.
    """
    left_out = {c for c, t in spec.types.items() if c == spec.target_column or spec.compat and t.lower() == "date_time"}
    group = {c: FEATURE_GROUP.get(t.lower()) for c, t in spec.types.items() if c not in left_out}
    return tuple([c for c, g in group.items() if g == wanted] for wanted in ("numeric", "categorical", "datetime"))


# What a missing field of a stored spec row reads as: the defaults of the options above.
SPEC_ROW_DEFAULTS = {
    f.name: f.default for f in fields(DatasetSpec)
    if isinstance(f.default, (bool, int, str)) and f.name not in ("dataset_description", "what_user_wants_to_do", "compat")
}


def read_specs(table: DataFrame) -> DataFrame:
    """Apply the per-field defaults to a table of stored specs."""
    present = set(table.columns)
    others = [c for c in table.columns if c not in SPEC_ROW_DEFAULTS]
    filled = [
        (F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)).alias(name)
        for name, value in SPEC_ROW_DEFAULTS.items()
    ]
    return table.select(*others, *filled)


def is_declared_type(data_type: T.DataType, declared: str) -> bool:
    """Does a Spark column type already satisfy a declared type?"""
    wanted = {
        "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
        "float": (T.FloatType, T.DoubleType),
        "bool": (T.BooleanType,),
        "str": (T.StringType,),
        "date": (T.DateType,),
        "date_time": (T.DateType,),
        "timedelta": (T.DayTimeIntervalType,),
        "uint": (),
        "category": (),
        "time": (),
        "complex": (),
    }
    if declared == "object":
        return True
    if declared == "complex":
        return isinstance(data_type, T.StructType) and data_type.names == ["re", "im"]
    if declared == "uint":
        return isinstance(data_type, T.DecimalType) and (data_type.precision, data_type.scale) == (20, 0)
    return isinstance(data_type, wanted.get(declared, ()))
