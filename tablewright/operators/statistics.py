"""Exact whole-column statistics that hold at any table size.

Spark's own ``median`` and ``mode`` keep every distinct value of a column in one
aggregation buffer. Here a mode is a grouped count reduced twice, and a median
is found by narrowing a bracket around its rank, so no task ever holds a column.
"""

from __future__ import annotations

from typing import Callable, Mapping, NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.casts import no_nan

# A bracket this small is sorted in one buffer.
SORT_ROWS = 200_000


def cell(df: DataFrame, name: str) -> Column:
    """A column with NaN read as missing."""
    return no_nan(F.col(f"`{name}`"), df.schema[name].dataType)


def present(df: DataFrame, name: str) -> Column:
    """Is the cell there? Written so that the null test reaches the file reader."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return column.isNotNull() & ~F.isnan(column)
    return column.isNotNull()


def _slots(df: DataFrame, name: str) -> list[Column]:
    """A cell as one of (long, double, text), so columns of any type can be stacked."""
    kind, value = df.schema[name].dataType, cell(df, name)
    none = (F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string"))
    as_long = {
        T.DateType: F.unix_date, T.TimestampType: F.unix_micros,
        T.TimestampNTZType: lambda c: F.unix_micros(c.cast("timestamp")),
        T.BooleanType: lambda c: c.cast("long"),
    }
    for data_type, convert in as_long.items():
        if isinstance(kind, data_type):
            return [convert(value).cast("long"), none[1], none[2]]
    if isinstance(kind, T.IntegralType):
        return [value.cast("long"), none[1], none[2]]
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return [none[0], value.cast("double") + F.lit(0.0), none[2]]
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        value = F.to_json(value)
    return [none[0], none[1], value.cast("string")]


def restore(df: DataFrame, name: str, value: Column) -> Column:
    """Turn the (long, double, text) form back into the column's own type."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value["as_long"].cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(value["as_long"]).cast(kind)
    if isinstance(kind, T.StructType):
        return F.from_json(value["as_text"], kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value["as_double"].cast(kind)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value["as_long"].cast(kind)
    return value["as_text"].cast(kind)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, as_long, as_double, as_text, n) for several columns in one scan.

    Missing cells appear as one row with all three forms null. Counts combine on
    the map side, so a value holding a third of the rows costs one row per task.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("col"), *[
            s.alias(a) for s, a in zip(_slots(df, name), ("as_long", "as_double", "as_text"))
        ])
        for i, name in enumerate(columns)
    ])
    stacked = df.select(F.inline(cells))
    return stacked.groupBy("col", "as_long", "as_double", "as_text").agg(F.count(F.lit(1)).alias("n"))


class Mode(NamedTuple):
    value: Column
    ties: int
    count: int


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, Mode]:
    """Smallest most frequent value of each column, and how many values share that count."""
    if not columns:
        return {}
    form = F.struct("as_long", "as_double", "as_text")
    counts = value_counts(df, columns).where("coalesce(as_text, cast(as_long as string), cast(as_double as string)) is not null")
    by_count = counts.groupBy("col", "n").agg(F.count(F.lit(1)).alias("ties"), F.min(form).alias("v"))
    best = by_count.groupBy("col").agg(
        F.max("n").alias("n"), F.max_by(F.struct("ties", "v"), "n").alias("m")
    )
    found = {}
    for row in best.collect():  # one row per column
        name, v = columns[row.col], row.m.v
        literal = F.struct(
            F.lit(v.as_long).cast("long").alias("as_long"),
            F.lit(v.as_double).cast("double").alias("as_double"),
            F.lit(v.as_text).cast("string").alias("as_text"),
        )
        found[name] = Mode(restore(df, name, literal), row.m.ties, row.n)
    return found


def select_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    ranks: Callable[[int], tuple[int, int]],
    sort_rows: int = SORT_ROWS,
    accuracy: int = 10_000,
    counts: Mapping[str, int] | None = None,
) -> dict[str, tuple[float, float] | None]:
    """Exact values at two ranks (0-based, in ascending order) of each double column.

    Every round brackets each wanted rank with two approximate percentiles and
    counts what lies on either side. Both edges are values of the column, so either
    one of them is the answer or the bracket loses them and everything outside: it
    shrinks by about ``accuracy / 4`` a round, and nothing is shuffled. A bracket
    small enough is sorted in one buffer.
    """
    if counts is None:
        counted = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns.values())]).first()
        counts = dict(zip(columns, counted))
    results: dict[tuple[str, int], float] = {}
    wanted: dict[str, tuple[int, int]] = {}
    open_: dict[tuple[str, int], _Bracket] = {}
    for name in columns:
        if n := counts[name]:
            wanted[name] = ranks(n)
            open_.update({(name, rank): _Bracket(None, None, 0, n) for rank in wanted[name]})

    while open_:
        ready = {key: b for key, b in open_.items() if b.inside <= sort_rows}
        if ready:
            results.update(_sorted_picks(df, columns, ready))
            for key in ready:
                del open_[key]
            continue
        margin, keys = 2.0 / accuracy, list(open_)
        cuts = []
        for name, rank in keys:
            b = open_[name, rank]
            low = max(0.0, (rank - b.below) / b.inside - margin)
            high = min(1.0, (rank - b.below + 1) / b.inside + margin)
            cuts.append(F.percentile_approx(b.of(columns[name]), [low, high], accuracy))
        edges = df.agg(*[c.alias(f"e{i}") for i, c in enumerate(cuts)]).first()
        tallies = []
        for (name, _), (lo, hi) in zip(keys, edges):
            c = columns[name]
            tallies += [F.count_if(c < F.lit(lo)), F.count_if(c <= F.lit(lo)), F.count_if(c < F.lit(hi)), F.count_if(c <= F.lit(hi))]
        tally = df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tallies)]).first()
        for i, key in enumerate(keys):
            (lo, hi), rank, b = edges[i], key[1], open_[key]
            lt_lo, le_lo, lt_hi, le_hi = tally[4 * i:4 * i + 4]
            if lt_lo <= rank < le_lo or lt_hi <= rank < le_hi:
                results[key] = lo if rank < le_lo else hi
                del open_[key]
            elif rank < lt_lo:
                open_[key] = _Bracket(b.lo, lo, b.below, lt_lo - b.below)
            elif rank >= le_hi:
                open_[key] = _Bracket(hi, b.hi, le_hi, b.below + b.inside - le_hi)
            else:
                open_[key] = _Bracket(lo, hi, le_lo, lt_hi - le_lo)
    return {
        name: (results[name, wanted[name][0]], results[name, wanted[name][1]]) if name in wanted else None
        for name in columns
    }


class _Bracket(NamedTuple):
    """Values strictly between ``lo`` and ``hi``: how many lie below it and inside it."""

    lo: float | None
    hi: float | None
    below: int
    inside: int

    def of(self, column: Column) -> Column:
        inside = F.lit(True)
        if self.lo is not None:
            inside = inside & (column > F.lit(self.lo))
        if self.hi is not None:
            inside = inside & (column < F.lit(self.hi))
        return column if self.lo is None and self.hi is None else F.when(inside, column)


def _sorted_picks(df: DataFrame, columns: Mapping[str, Column], ready: dict) -> dict:
    """Wanted values of small brackets; ranks that share a bracket share its sort."""
    brackets = list(dict.fromkeys((name, b) for (name, _), b in ready.items()))
    arrays = df.agg(*[F.sort_array(F.collect_list(b.of(columns[name]))).alias(f"a{i}") for i, (name, b) in enumerate(brackets)])
    picks = arrays.select(*[
        F.element_at(F.col(f"a{brackets.index((name, b))}"), rank - b.below + 1).alias(f"v{i}")
        for i, ((name, rank), b) in enumerate(ready.items())
    ]).first()
    return dict(zip(ready, picks))


def medians(df: DataFrame, columns: Sequence[str], **how) -> dict[str, float | None]:
    """Exact median of each column: the midpoint of the two middle values."""
    if not columns:
        return {}
    cells = {c: cell(df, c).cast("double") for c in columns}
    found = select_ranks(df, cells, lambda n: ((n - 1) // 2, n // 2), **how)
    return {c: None if v is None else (v[0] + v[1]) / 2.0 for c, v in found.items()}


def means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    if not columns:
        return {}
    row = df.agg(*[F.avg(cell(df, c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))
