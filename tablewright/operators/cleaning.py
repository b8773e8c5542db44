"""Typing, null handling, de-duplication and column pruning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import casts
from tablewright.functions.hashing import hash_fraction
from tablewright.operators import statistics
from tablewright.operators.lookup import lookup
from tablewright.operators.statistics import cell
from tablewright.runtime import cut
from tablewright.spec import DatasetSpec, is_declared_type


# Copies of one row that one task makes.
COPIES_TOGETHER = 4096


def _numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {c: casts.to_number(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns}


def conversions(df: DataFrame, spec: DatasetSpec) -> dict[str, Column]:
    """The typed expression of every declared column that needs converting.

    Whether an int column holds fractions, or a uint one negatives, decides its
    final type; one aggregation answers that for all such columns.
    """
    wanted = {
        c: t for c, t in spec.declared(df).items() if not is_declared_type(df.schema[c].dataType, t)
    }
    whole = [c for c, t in wanted.items() if t in ("int", "uint")]
    numbers = _numbers(df, whole)
    facts = {}
    if whole:
        row = df.agg(*[
            e for c in whole for e in (
                F.coalesce(F.bool_or(casts.has_fraction(numbers[c])), F.lit(False)),
                F.coalesce(F.min(numbers[c]) < 0, F.lit(False)),
            )
        ]).first()
        facts = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(whole)}

    out: dict[str, Column] = {}
    for name, declared in wanted.items():
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        mapping = spec.value_maps.get(name)
        if declared in ("int", "uint"):
            fraction, negative = facts[name]
            exact = casts.to_number(column, kind) if fraction else _whole(column, kind)
            if declared == "uint" and (fraction or negative):
                continue
            out[name] = exact.cast("decimal(20,0)") if declared == "uint" else exact
        elif declared == "float":
            out[name] = casts.to_number(column, kind)
        elif declared in ("date_time", "date"):
            out[name] = casts.to_date(column, kind, spec.date_formats)
        elif declared == "time":
            out[name] = casts.to_time(column, kind, spec.date_formats)
        elif declared == "timedelta":
            out[name] = casts.to_timedelta(column, kind)
        elif declared == "bool":
            out[name] = casts.to_bool(column, mapping)
        elif declared == "category":
            out[name] = casts.to_category(column, mapping)
        elif declared == "str":
            out[name] = casts.to_text(column)
        elif declared == "complex":
            out[name] = casts.to_complex(column)
        # any other declared type leaves the column as it is
    return out


def _whole(column: Column, kind: T.DataType) -> Column:
    """Long; integer texts are read directly so that large ones keep every digit."""
    number = casts.to_number(column, kind)
    as_long = F.when(F.abs(number) < 9.2e18, number).cast("long")
    return F.coalesce(column.try_cast("long"), as_long) if isinstance(kind, T.StringType) else as_long


def enforce_types(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Convert every declared column in a single projection."""
    changed = conversions(df, spec)
    return df.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def cast_report(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """(column, declared, new_nulls): cells each conversion could not read."""
    changed = conversions(df, spec)
    declared = spec.declared(df)
    counts = [
        F.count_if(cell(df, c).isNotNull() & changed[c].isNull()) if c in changed else F.lit(0).cast("long")
        for c in declared
    ]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("declared"), F.col(f"c{i}").alias("new_nulls"))
        for i, (c, t) in enumerate(declared.items())
    ])
    counted = df.agg(*[n.alias(f"c{i}") for i, n in enumerate(counts)])
    return counted.select(F.inline(rows))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all; one aggregation finds them."""
    row = df.agg(*[F.count(cell(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if row[i]])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header; ``read_csv`` names them ``Unnamed: <position>``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    for name in df.columns if subset is None else subset:
        df = df.where(statistics.present(df, name))
    return df


def split_target(df: DataFrame, target: str | None) -> DataFrame:
    """Features plus the target as ``label``; without a target all are features."""
    return df.withColumnRenamed(target, "label") if target else df


def fill_columns(df: DataFrame, columns: Sequence[str], method: str = "mean") -> DataFrame:
    """Fill missing numeric cells by mean, median, mode or the constant 0."""
    values = _numeric_fills(df, columns, method)
    return df.withColumns({
        c: F.coalesce(cell(df, c).cast("double"), v) for c, v in values.items() if v is not None
    })


def _numeric_fills(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, Column | None]:
    method = method or "mean"
    if method == "mean":
        return {c: None if v is None else F.lit(v) for c, v in statistics.means(df, columns).items()}
    if method == "median":
        return {c: None if v is None else F.lit(v) for c, v in statistics.medians(df, columns).items()}
    if method == "mode":
        return {c: m.value.cast("double") for c, m in statistics.modes(df, columns).items()}
    if method == "custom_value":
        return {c: F.lit(0.0) for c in columns}
    return {}  # "none" or an unknown method fills nothing


def round_whole(column: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.bround(column, 0).cast("long")


def fill_most_frequent(df: DataFrame, columns: Sequence[str], unique_only: bool = False) -> DataFrame:
    """Fill with the smallest mode; ``unique_only`` drops the rows instead on a tie."""
    found = statistics.modes(df, columns)
    usable = {c: m for c, m in found.items() if m.ties == 1 or not unique_only}
    filled = df.withColumns({c: F.coalesce(cell(df, c), m.value) for c, m in usable.items()})
    return drop_null_rows(filled, [c for c in columns if c not in usable]) if unique_only else filled


def handle_nulls(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Drop empty columns, fill by declared type, then drop rows still incomplete.

    See ``null_plan``; without declared types nothing is filled.
    """
    required, out = null_plan(df, spec)
    return drop_null_rows(df, required).select(*[value.alias(c) for c, value in out.items()])


def null_plan(df: DataFrame, spec: DatasetSpec) -> tuple[list[str], dict[str, Column]]:
    """What ``handle_nulls`` does to ``df``: the columns that must be present, and every kept column's expression.

    All fills come from the table before any row is dropped. Columns of a type
    that is never filled (date, bool, uint, complex, object) lose their null rows.
    One aggregation finds the empty columns, the means and the counts the medians
    start from; the result is one filter and one projection.
    """
    df = drop_unnamed(df)
    declared = spec.declared(df)
    method = spec.fill_method()
    numeric = [c for c, t in declared.items() if t in ("int", "float")]
    averaged = numeric if method == "mean" else []
    facts = df.agg(
        *[F.count(cell(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.avg(cell(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(averaged)],
    ).first()
    counts = {c: facts[f"n{i}"] for i, c in enumerate(df.columns)}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if counts[c]])
    if not spec.types:
        return df.columns, {c: F.col(f"`{c}`") for c in df.columns}
    filled = lambda columns: [c for c in columns if counts[c]]
    of = lambda *kinds: filled(c for c, t in declared.items() if t in kinds)
    strings, frequent = of("str"), of("category", "date_time", "time", "timedelta")
    texts_with_mode = strings if spec.fill_string_type_columns else []

    found = statistics.modes(df, frequent + texts_with_mode + (filled(numeric) if method == "mode" else []))
    fills: dict[str, Column] = {c: found[c].value for c in frequent}
    fills |= {c: found[c].value for c in texts_with_mode if found[c].ties == 1}
    if method == "mean":
        values = {c: F.lit(facts[f"m{i}"]) for i, c in enumerate(numeric) if counts[c]}
    elif method == "median":
        middle = statistics.medians(df, filled(numeric), counts=counts)
        values = {c: F.lit(v) for c, v in middle.items()}
    else:
        values = _numeric_fills(df, filled(numeric), method) if method != "mode" else {
            c: found[c].value.cast("double") for c in filled(numeric)}

    out = {c: F.coalesce(cell(df, c), v) for c, v in fills.items()}
    for name in filled(numeric):
        value = F.coalesce(cell(df, name).cast("double"), values[name]) if name in values else cell(df, name)
        out[name] = round_whole(value) if declared[name] == "int" else value
    # Filled columns are complete; only the others can still cost a row.
    required = [c for c in df.columns if c not in fills and c not in values]
    return required, {c: out.get(c, cell(df, c)) for c in df.columns}


@dataclass
class CleaningModel:
    """Conversions, fills and kept columns as fitted on one table, for rows that arrive later."""

    typed: dict[str, Column]
    required: list[str]
    out: dict[str, Column]
    remove_duplicate: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """Typed, filled and complete rows; neither a shuffle nor a look at other rows."""
        typed = df.select(*[value.alias(c) for c, value in self.typed.items()])
        return drop_null_rows(typed, self.required).select(*[value.alias(c) for c, value in self.out.items()])


def fit_cleaning(df: DataFrame, spec: DatasetSpec) -> CleaningModel:
    """Learn from the history what ``enforce_types`` and ``handle_nulls`` would do to it."""
    changed = conversions(df, spec)
    typed = {c: changed.get(c, F.col(f"`{c}`")) for c in df.columns}
    required, out = null_plan(df.select(*[value.alias(c) for c, value in typed.items()]), spec)
    return CleaningModel(typed, required, out, spec.remove_duplicate)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows; missing cells count as equal.

    Equal rows collapse on the map side before the one shuffle.
    """
    plain = df.select(*[cell(df, c).alias(c) for c in df.columns])
    return plain.dropDuplicates()


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Drop each numeric column that correlates above ``threshold`` with a kept earlier one."""
    strong = correlated_pairs(df, columns, threshold) if len(columns) > 1 else set()
    kept: list[str] = []
    for b in columns:
        if not any((a, b) in strong for a in kept):
            kept.append(b)
    dropped = set(columns) - set(kept)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in dropped])


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float) -> set[tuple[str, str]]:
    """Pairs (a, b) of columns, a first, whose rows with both present correlate above ``threshold``.

    One pass for the means and one for all pairs: each task sums its rows as small matrices
    over the columns, and the rows of these matrices meet per column.
    """
    width = len(columns)
    numbers = [cell(df, c).cast("double") for c in columns]
    means = np.array([v or 0.0 for v in df.agg(*[F.avg(n).alias(f"m{i}") for i, n in enumerate(numbers)]).first()])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, width, width))
        for frame in batches:
            for at in range(0, len(frame), 4096):
                x = np.stack(frame["x"].iloc[at: at + 4096].to_numpy()).astype(float) - means
                here = np.isfinite(x).astype(float)
                x = np.where(here > 0, x, 0.0)
                own, square = x.T @ here, (x * x).T @ here
                total += np.stack([here.T @ here, own, own.T, square, square.T, x.T @ x])
        yield pd.DataFrame({"i": range(width), "m": [total[:, i].ravel() for i in range(width)]})

    def strong(frame: pd.DataFrame) -> pd.DataFrame:
        n, sx, sy, sxx, syy, sxy = np.sum(np.stack(frame["m"].to_numpy()), axis=0).reshape(6, width)
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = (n * sxx - sx * sx) * (n * syy - sy * sy)
            r = np.where(spread > 0, (n * sxy - sx * sy) / np.sqrt(spread), 0.0)
        i = int(frame["i"].iat[0])
        near = [j for j in np.flatnonzero(np.abs(r) > threshold) if j > i]
        return pd.DataFrame({"i": [i] * len(near), "j": near}, dtype="int64")

    parts = df.select(F.array(*numbers).alias("x")).mapInPandas(sums, "i long, m array<double>")
    found = parts.groupBy("i").applyInPandas(strong, "i long, j long").collect()  # pairs of columns
    return {(columns[r.i], columns[r.j]) for r in found}


def oversample(df: DataFrame, label: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Repeat rows of the rarer classes until classes are about equally large.

    Each row is kept ``floor(f)`` times, and once more when its hash falls below
    the rest of ``f = largest / own``. Rows are copied where they lie; only the
    per-class counts travel. Where a row has very many copies, runs of them are dealt to
    other tasks first. A row without a class is kept as it is.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("_class")).agg(F.count(F.lit(1)).alias("n"))
    factors = cut(counts, "classes")
    largest = float(factors.agg(F.max("n")).first()[0] or 0)
    joined = lookup(df, factors.withColumn("_f", F.lit(largest) / F.col("n")), label, "_class", "_f")
    joined = joined.withColumn("_f", F.coalesce("_f", F.lit(1.0)))
    extra = hash_fraction(key, seed) < F.col("_f") - F.floor("_f")
    counted = joined.withColumn("_copies", F.floor("_f") + extra.cast("long")).drop("_f")
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPIES_TOGETHER))
    dealt = counted.withColumn("_run", F.explode(runs))
    least = factors.agg(F.min("n")).first()[0]
    if least and largest / least > COPIES_TOGETHER:
        dealt = dealt.repartition(F.col(label), F.col("_run"), hash_fraction(key, seed))
    first = F.col("_run") * COPIES_TOGETHER + 1
    return dealt.withColumn("copy", F.explode(F.sequence(first, F.least("_copies", first + COPIES_TOGETHER - 1)))).drop("_copies", "_run")
