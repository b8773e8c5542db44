"""Declared-type conversions as column expressions. Bad values become null."""

from __future__ import annotations

from typing import Any, Mapping, Sequence

from pyspark.sql import Column, functions as F, types as T

# Texts read as a missing cell.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Texts of true and of false.
TRUE_TOKENS = ("true", "1", "yes")
FALSE_TOKENS = ("false", "0", "no")

# Date layouts tried after ISO, in this order, when none are declared.
DATE_FORMATS = ("MM/dd/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "yyyyMMdd")

# Duration units in microseconds.
UNIT_MICROS = {
    "d": 86_400_000_000,
    "h": 3_600_000_000,
    "m": 60_000_000,
    "s": 1_000_000,
    "ms": 1_000,
    "us": 1,
}
_UNIT_WORDS = {
    "d": "d|days?",
    "h": "h|hr|hrs|hours?",
    "m": "m|min|mins|minutes?",
    "s": "s|sec|secs|seconds?",
    "ms": "ms|milli|millis|milliseconds?",
    "us": "us|micro|micros|microseconds?",
}
_INFINITE = ("inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")


def no_nan(column: Column, data_type: T.DataType) -> Column:
    """A floating NaN is a missing cell."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def null_tokens(column: Column) -> Column:
    return F.when(~column.isin(*NULL_TOKENS), column)


def to_number(column: Column, data_type: T.DataType) -> Column:
    """Double, or null where the cell is not a number."""
    if not isinstance(data_type, T.StringType):
        if isinstance(data_type, (T.NumericType, T.BooleanType)):
            return no_nan(column.cast("double"), T.DoubleType())
        return no_nan(column.cast("string").try_cast("double"), T.DoubleType())
    text = F.trim(column)
    # Spark also reads a trailing d or f as a type suffix; only infinities may end so.
    suffixed = F.lower(F.substring(text, -1, 1)).isin("d", "f")
    number = F.when(~suffixed | F.lower(text).isin(*_INFINITE), text.try_cast("double"))
    return no_nan(number, T.DoubleType())


def has_fraction(number: Column) -> Column:
    return number.isNotNull() & (number != F.floor(number).cast("double"))


def to_timestamp(column: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    text = F.trim(column.cast("string"))
    if formats:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.coalesce(
        text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    )


def to_date(column: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    if isinstance(data_type, T.DateType):
        return column
    return F.to_date(to_timestamp(column, data_type, formats))


def to_time(column: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    return F.date_format(to_timestamp(column, data_type, formats), "HH:mm:ss")


def to_text(column: Column, empty: bool = False) -> Column:
    """Text; ``empty=True`` writes '' for a missing cell, otherwise it stays null."""
    text = column.cast("string")
    return F.coalesce(text, F.lit("")) if empty else text


def _mapped(text: Column, mapping: Mapping[str, Any]) -> Column:
    pairs = [F.lit(x) for key, value in mapping.items() for x in (key, value)]
    return F.element_at(F.create_map(*pairs), text)


def to_bool(column: Column, mapping: Mapping[str, bool] | None = None) -> Column:
    """Never null: anything not known to be true is false."""
    text = F.lower(F.trim(column.cast("string")))
    known = F.when(text.isin(*TRUE_TOKENS), F.lit(True)).when(text.isin(*FALSE_TOKENS), F.lit(False))
    if mapping:
        known = F.coalesce(_mapped(text, {k: bool(v) for k, v in mapping.items()}), known)
    return F.coalesce(known, F.lit(False))


def to_category(column: Column, mapping: Mapping[str, str] | None = None) -> Column:
    """Trimmed lower-case text, mapped where a mapping names it; nulls stay null."""
    text = F.lower(F.trim(column.cast("string")))
    text = F.when(text != "nan", text)
    return F.coalesce(_mapped(text, mapping), text) if mapping else text


def timedelta_micros(column: Column) -> Column:
    """Microseconds of a duration text; a bare number counts nanoseconds."""
    text = F.lower(F.trim(column.cast("string")))
    clock = r"(\d+):(\d{1,2}):(\d{1,2}(?:\.\d+)?)"
    units = "|".join(f"(?:{w})" for w in _UNIT_WORDS.values())
    shape = rf"^[+-]?\s*(?:\d+(?:\.\d+)?\s*(?:{units})(?![a-z])[\s,]*)*[+]?(?:{clock})?$"
    bare = text.rlike(r"^[+-]?\d+(\.\d+)?$")

    def part(pattern: str, group: int) -> Column:
        found = F.regexp_extract(text, pattern, group)
        return F.coalesce(F.nullif(found, F.lit("")).try_cast("double"), F.lit(0.0))

    total = (
        part(clock, 1) * UNIT_MICROS["h"] + part(clock, 2) * UNIT_MICROS["m"]
        + part(clock, 3) * UNIT_MICROS["s"]
    )
    for unit, words in _UNIT_WORDS.items():
        total = total + part(rf"(\d+(?:\.\d+)?)\s*(?:{words})(?![a-z])", 1) * UNIT_MICROS[unit]
    signed = F.when(text.startswith("-"), -total).otherwise(total)
    micros = F.when(bare, text.try_cast("double") / 1000.0).when(text.rlike(shape) & (text != ""), signed)
    return F.when(micros >= 0, F.floor(micros + 1e-6)).otherwise(F.ceil(micros - 1e-6)).cast("long")


def to_timedelta(column: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.DayTimeIntervalType):
        return column
    seconds = timedelta_micros(column).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(8,0)")
    return F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def to_complex(column: Column) -> Column:
    """struct(re, im), or null for a malformed value."""
    text = F.regexp_replace(F.trim(column.cast("string")), r"^\((.*)\)$", "$1")
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    full = rf"^({number})(?:([+-](?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)?)[jJ])?$"
    pure = rf"^({number}|[+-]?)[jJ]$"

    def coefficient(value: Column) -> Column:
        return (
            F.when(value.isin("", "+"), F.lit(1.0)).when(value == "-", F.lit(-1.0))
            .otherwise(value.try_cast("double"))
        )

    imaginary = F.regexp_extract(text, full, 2)
    return F.when(
        text.rlike(pure),
        F.struct(F.lit(0.0).alias("re"), coefficient(F.regexp_extract(text, pure, 1)).alias("im")),
    ).when(
        text.rlike(full),
        F.struct(
            F.regexp_extract(text, full, 1).try_cast("double").alias("re"),
            F.when(imaginary == "", F.lit(0.0)).otherwise(coefficient(imaginary)).alias("im"),
        ),
    )
