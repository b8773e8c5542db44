"""Reading and writing datasets."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.casts import null_tokens
from tablewright.operators.profile import infer_types
from tablewright.runtime import new_folder
from tablewright.sources.records import csv_records
from tablewright.spec import DatasetSpec

# Formats a dataset may arrive in.
FORMATS = ("csv", "parquet")


def read_csv(spark: SparkSession, path: str, spec: DatasetSpec | None = None, infer: bool = True, line_breaks: bool = True) -> DataFrame:
    """CSV with a header; the usual texts for a missing cell become null.

    Cells may hold line breaks, and large files are split all the same (``csv_records``);
    ``line_breaks=False`` promises that no cell does and saves a pass. Records end at a line
    feed, or a carriage return and one. A column without a header is called
    ``Unnamed: <position>``.

    With declared types the cells stay text for ``enforce_types`` to convert.
    Otherwise one pass finds each column's type.
    """
    options = {"escape": '"', "multiLine": line_breaks, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw = spark.read.options(header=True, **options).csv(path)
    names = raw.columns
    if any(c == f"_c{i}" for i, c in enumerate(names)):  # perhaps named so by the reader
        head = spark.read.options(**options).csv(path).first()
        names = [f"Unnamed: {i}" if not head[i] else c for i, c in enumerate(names)]
    if names and names[-1].endswith("\r"):  # of the line's end
        names[-1] = names[-1].removesuffix("\r") or f"Unnamed: {len(names) - 1}"
    if line_breaks and names:
        raw = _parsed(csv_records(spark, path).where("start > 0 or n > 0"), len(names), options)
    texts = raw.select(*[null_tokens(F.col(f"`{c}`")).alias(n) for c, n in zip(raw.columns, names)])
    if spec is not None and spec.types or not infer:
        return texts
    types = infer_types(texts)
    return texts.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) for c in texts.columns])


def _parsed(records: DataFrame, width: int, options: dict) -> DataFrame:
    """Cells of ``csv_records``, all text."""
    columns = [f"c{i}" for i in range(width)]
    text = F.regexp_replace("text", "\r$", "")
    cells = F.from_csv(text, ", ".join(f"{c} string" for c in columns), {k: str(v).lower() for k, v in options.items()})
    return records.select(cells.alias("r")).select(*[F.col(f"r.{c}") for c in columns])


def accepted(path: str) -> Column:
    """Does a column of paths end in the extension of a format that datasets may arrive in?"""
    return F.regexp_extract(F.lower(F.rtrim(F.col(path), F.lit("/"))), r"\.([^./]+)$", 1).isin(*FORMATS)


def read_dataset(spark: SparkSession, path: str, spec: DatasetSpec | None = None) -> DataFrame:
    """Read a dataset by extension; any other format is refused."""
    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if kind not in FORMATS:
        raise ValueError(f"only {' and '.join(FORMATS)} datasets are accepted, not {path!r}")
    return read_csv(spark, path, spec) if kind == "csv" else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    """Export with a header; tasks write in parallel."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_version(df: DataFrame, base: str, done: bool = False) -> str:
    """Write a new version of a dataset, then switch the pointer table to it.

    Readers see the old version until the pointer row is written.
    """
    version = f"{base}/v{time.time_ns()}"
    df.write.parquet(version)
    pointer = df.sparkSession.createDataFrame([(version, done, time.time_ns())], "path string, done boolean, ts long")
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/versions")
    return version


def load_best(spark: SparkSession, base: str, raw: str) -> DataFrame:
    """The latest finished version, or the raw dataset when there is none."""
    from pyspark.errors import AnalysisException

    try:
        latest = spark.read.parquet(f"{base}/versions").where("done").orderBy(F.desc("ts")).first()
    except AnalysisException:
        latest = None
    return spark.read.parquet(latest.path) if latest else read_dataset(spark, raw)


def round_trip_csv(df: DataFrame) -> DataFrame:
    """Write a table as CSV in the shared folder and read it back."""
    return read_csv(df.sparkSession, write_csv(df, new_folder(df.sparkSession, "export") + ".csv"))
