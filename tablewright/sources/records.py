"""CSV records with line breaks in quoted cells, read by many tasks from one large file.

The file is read by lines in byte ranges, as Spark splits it. Whether a range begins inside
a quoted cell is not known from the range alone, so a first pass works out for both cases
how it ends; putting these together range by range gives the state each one begins in. In
the second pass a range joins the lines of every record that begins in it. A record that
goes on in later ranges leaves a piece in each, and only those pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.runtime import cut

QUOTE, COMMA = '"', ","


def state_after(line: str, inside: bool) -> bool:
    """Does the line that begins inside a quoted cell (or not) end inside one?

    A quote opens a cell at its beginning only, and two quotes in a quoted cell are one of
    its letters; what follows the closing quote belongs to the cell up to the next comma.
    """
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith(QUOTE, at):
            inside = True
            at += 1
            continue
        at = line.find(COMMA, at)
        if at < 0:
            return False
        at += 1


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of every byte range, in order within a range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(frame: pd.DataFrame) -> Iterator[tuple[tuple[int, int], pd.DataFrame]]:
    """Consecutive rows of one byte range."""
    file, start = frame["file"].to_numpy(), frame["start"].to_numpy()
    edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(frame)]):
        if high > low:
            yield (int(file[low]), int(start[low])), frame.iloc[low:high]


def _quoted(lines: pd.Series) -> list[int]:
    return [i for i, line in enumerate(lines) if QUOTE in line]


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How every range ends if it begins outside or inside a quoted cell, and whether a record begins in it in the latter case."""
    key, out = None, []

    def done() -> None:
        if key is not None:
            out.append((*key, outer, inner, begins))

    for frame in frames:
        for own, part in _ranges(frame):
            if own != key:
                done()
                key, outer, inner, begins, closed = own, False, True, False, False
            begins |= closed  # a line follows the one that closed the cell
            for i in _quoted(part["value"]):
                line = part["value"].iat[i]
                outer, was, inner = state_after(line, outer), inner, state_after(line, inner)
                if was and not inner:
                    closed = True
                    begins |= i + 1 < len(part)
    done()
    yield pd.DataFrame(out, columns=["file", "start", "outer", "inner", "begins"])


def _chained(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state every range of one file begins in, and the range in which its first record began."""
    ranges = ranges.sort_values("start")
    inside, owner, rows = False, 0, []
    for r in ranges.itertuples():
        rows.append([r.file, r.start, inside, owner, False])
        if not inside or r.begins:
            owner = r.start
        inside = r.inner if inside else r.outer
        rows[-1][4] = inside
    return pd.DataFrame(rows, columns=["file", "start", "inside", "owner", "open"])


class _Assembly:
    """Records of one byte range."""

    def __init__(self, key: tuple[int, int], inside: bool, owner: int):
        self.key, self.inside, self.owner = key, inside, owner
        self.held: list[str] = []  # lines of a record that is not complete yet
        self.n = -1 if inside else 0  # number of the record that is being read

    def add(self, lines: list[str], quoted: list[int]) -> list[tuple]:
        """Complete records among some more lines."""
        after = np.zeros(len(lines), bool)
        low = 0
        for i in quoted:
            after[low:i] = self.inside
            self.inside = state_after(lines[i], self.inside)
            after[i], low = self.inside, i + 1
        after[low:] = self.inside
        rows, low = [], 0
        for end in np.flatnonzero(~after).tolist():
            text = lines[low] if end == low and not self.held else "\n".join([*self.held, *lines[low: end + 1]])
            self.held, low = [], end + 1
            if self.n >= 0 and text in ("", "\r"):
                continue  # no record
            rows.append(self._row(text, self.n >= 0))
            self.n += 1
        self.held += lines[low:]
        return rows

    def _row(self, text: str, whole: bool) -> tuple:
        file, start = self.key
        return file, self.owner if self.n < 0 else start, start, max(self.n, 0), text, whole

    def end(self) -> list[tuple]:
        return [self._row("\n".join(self.held), False)] if self.held else []


_RECORD = "file long, owner long, start long, n long, text string, whole boolean"


def _assembled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current = None
    columns = [c.split(" ")[0] for c in _RECORD.split(", ")]
    for frame in frames:
        rows = []
        for key, part in _ranges(frame):
            if current is None or current.key != key:
                rows += current.end() if current else []
                current = _Assembly(key, bool(part["inside"].iat[0]), int(part["owner"].iat[0]))
            rows += current.add(part["value"].tolist(), _quoted(part["value"]))
        yield pd.DataFrame(rows, columns=columns)
    if current is not None:
        yield pd.DataFrame(current.end(), columns=columns)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, n, text): every record of the CSV files at ``path`` as one text, line breaks in quoted cells kept.

    Record n of the byte range at ``start`` of a file; empty lines are none. ``file`` is a hash of its path. Cells
    are separated by commas; see ``state_after`` for quotes. One row per byte range is sent
    to every task. Compressed files are one range each.
    """
    lines = file_lines(spark, path)
    ends = lines.mapInPandas(_ends, "file long, start long, outer boolean, inner boolean, begins boolean")
    schema = "file long, start long, inside boolean, owner long, open boolean"
    ranges = cut(ends.groupBy("file").applyInPandas(_chained, schema), "ranges")
    known = F.broadcast(ranges)
    whole = lines.join(known.drop("open"), ["file", "start"]).mapInPandas(_assembled, _RECORD).where("whole").select("file", "start", "n", "text")
    if ranges.where("inside or open").isEmpty():
        return whole
    # Records over several ranges: only the ranges that hold a piece of one are read again.
    some = lines.join(F.broadcast(ranges.where("inside or open").drop("open")), ["file", "start"])
    pieces = some.mapInPandas(_assembled, _RECORD).where("not whole")
    joined = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "n", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: p["text"]), "\n")
    return whole.union(joined.select("file", F.col("owner").alias("start"), F.col("p")[0]["n"].alias("n"), text.alias("text")))
