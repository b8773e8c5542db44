"""Exact substring de-duplication by level-wise doubling of word windows.

A window of ``length`` words repeats only if the windows of ``start`` words inside it do.
So the shortest level looks at one short window per long one (the one with the smallest
hash, which equal long windows agree on), keeps those that repeat, and only what they
support is looked at again at twice the length, until ``length`` is reached or nothing
survives. Neighbouring windows with the same short one form a block. Equal blocks are
compared whole: all but the first are removed at once, and only first blocks go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm import arrays as A
from tablewright.llm.tables import numbered, packed, settled, unpacked

LENGTH = 20
START = 10
# A run of words is packed as first word << RUN_BITS | number of windows or words.
RUN_BITS = 20


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hashes of all windows of ``n`` words, by doubling while n is even."""
    return A.twice(_window_hashes(words, n // 2), n // 2) if n % 2 == 0 else A.gram_hashes(words, n)


class _Block:
    """The words of several texts, and the starts of the windows that are still candidates."""

    def __init__(self, texts: list[bytes], runs: list | None, length: int):
        _, _, _, self.words, self.first = A.block_words(texts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        n = len(self.words) - length + 1
        if n <= 0:
            self.windows = np.empty(0, np.int64)
            return
        inside = self.doc[:n] == self.doc[length - 1:]
        if runs is not None:
            edge = np.zeros(len(self.words) + 1, np.int32)
            for own, base in zip(runs, self.first):
                if own is not None and len(own):
                    own = np.asarray(own, np.int64)
                    low = base + (own >> RUN_BITS)
                    np.add.at(edge, low, 1)
                    np.add.at(edge, low + (own & (1 << RUN_BITS) - 1), -1)
            inside &= np.cumsum(edge)[:n] > 0
        self.windows = np.flatnonzero(inside)

    def anchors(self, level: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of the smallest window of ``level`` words inside each window of ``length``."""
        hashes = A.mix64(_window_hashes(self.words, level))
        at = A.sliding_argmin(hashes, length - level + 1)[self.windows]
        return hashes[at], at

    def places(self, at: np.ndarray) -> np.ndarray:
        return at - self.first[self.doc[at]]


def _texts(frame: pd.DataFrame, with_runs: bool) -> Iterator[tuple[np.ndarray, list[bytes], list | None]]:
    numbers = frame["_n"].to_numpy()
    for low, texts in A.text_blocks(frame["text"]):
        yield numbers[low: low + len(texts)], texts, frame["runs"].iloc[low: low + len(texts)].tolist() if with_runs else None


def candidate_blocks(docs: DataFrame, level: int, length: int) -> DataFrame:
    """Blocks of candidate windows that share their anchor: its hash ``a``, one of all words of the block ``b``; see ``_gathered``."""
    with_runs = "runs" in docs.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for numbers, texts, runs in _texts(frame, with_runs):
                block = _Block(texts, runs, length)
                w = block.windows
                if not len(w):
                    continue
                h, at = block.anchors(level, length)
                new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(w, prepend=-2) != 1) | (np.diff(block.doc[w], prepend=-1) != 0))
                start, size = w[new], np.diff(new, append=len(w))
                yield _gathered(h[new], _spans(block.words, start, start + size + length - 1), numbers[block.doc[start]], block.places(start) << RUN_BITS | size)

    return docs.mapInPandas(run, _GATHERED)


_GATHERED = "a long, b long, _n long, place long, c long"


def _gathered(a: np.ndarray, b: np.ndarray, numbers: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Rows (a, b, _n, place, c) of which equal (a, b) have met: the first has their count, for the others c is 0.

    Those are settled: something equal comes earlier. They get keys of their own, so that
    what one text repeats very often is spread and not gathered in one task.
    """
    order = np.lexsort((place, numbers, b, a))
    a, b, numbers, place = a[order], b[order], numbers[order], place[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    count = np.zeros(len(a), np.int64)
    heads = np.flatnonzero(first)
    count[heads] = np.diff(heads, append=len(a))
    own = A.mix64(numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    return pd.DataFrame({"a": A.signed(np.where(first, a, own)), "b": A.signed(np.where(first, b, ~own)), "_n": numbers, "place": place, "c": count})


def _spans(words: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of runs of words of any length."""
    up, down = A._power_tables(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return A.mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def candidate_windows(docs: DataFrame, level: int, length: int) -> DataFrame:
    """Every candidate window with its hash ``a`` and that of its anchor ``b``, 128 bits together; see ``_gathered``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for numbers, texts, runs in _texts(frame, True):
                block = _Block(texts, runs, length)
                if len(block.windows):
                    whole = A.mix64(_window_hashes(block.words, length)[block.windows])
                    yield _gathered(whole, block.anchors(level, length)[0], numbers[block.doc[block.windows]], block.places(block.windows))

    return docs.mapInPandas(run, _GATHERED)


def _with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Documents with the list of their runs; a document's runs are no more than its words."""
    return docs.join(runs.groupBy("_n").agg(F.collect_list("run").alias("runs")), "_n", how)


def repeated_runs(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """(_n, run): runs of words covered by windows that also start earlier. ``docs`` has _n and text."""
    levels = [start]
    while levels[-1] * 2 < length:
        levels.append(levels[-1] * 2)
    if not 0 < start < length:
        raise ValueError("start lies between 1 and length - 1")
    found, docs_now = [], docs
    earliest = Window.partitionBy("a", "b").orderBy("_n", "place")
    for level in levels:
        blocks = candidate_blocks(docs_now, level, length).repartition("a")
        ranked = blocks.withColumn("first", F.row_number().over(earliest) == 1).withColumn("places", F.sum("c").over(Window.partitionBy("a")))
        kept = settled(ranked.where("places <> 1").select("_n", F.col("place").alias("run"), (F.col("first") & (F.col("c") > 0)).alias("first")), "blocks")
        found.append(kept.where("not first").select("_n", (F.col("run") + (length - 1)).alias("run")))
        docs_now = _with_runs(docs, kept.where("first").select("_n", "run"), "inner")
        if kept.isEmpty():
            break
    else:
        windows = candidate_windows(docs_now, levels[-1], length).repartition("a")
        later = windows.withColumn("rank", F.row_number().over(earliest)).where("rank > 1 or c = 0")
        found.append(settled(later.select("_n", (F.shiftleft("place", RUN_BITS) + length).alias("run")), "windows"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def keep_words(raw: bytes, runs) -> tuple[bytes, int, int]:
    """The words outside ``runs`` joined by one space, how many words there were and how many went."""
    data = np.frombuffer(raw + b" ", np.uint8)
    starts, ends = A.word_bounds(data)
    n, gone = len(starts), 0
    if runs is not None and len(runs):
        runs = np.asarray(runs, np.int64)
        edge, low = np.zeros(n + 1, np.int32), runs >> RUN_BITS
        np.add.at(edge, low, 1)
        np.add.at(edge, low + (runs & (1 << RUN_BITS) - 1), -1)
        stay = np.cumsum(edge)[:n] == 0
        starts, ends = starts[stay], ends[stay]
        gone = n - len(starts)
    if not len(starts):
        return b"", n, gone
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] = 1
    mark[ends + 1] -= 1
    out = data.copy()
    out[ends] = 0x20
    return out[np.cumsum(mark, dtype=np.int8)[:-1].astype(bool)].tobytes()[:-1], n, gone


def dedup_substrings(docs: DataFrame, length: int = LENGTH, start: int = START) -> DataFrame:
    """``docs`` with ``text`` cut down to its kept words, and n_words and n_removed.

    Words are runs of other than ASCII white space. A word goes if a window of ``length``
    words that covers it also starts earlier: in a document with smaller doc_id, or before
    in the same one. Windows are judged on the input. Kept words are joined by one space.

    * A null text has no words and becomes an empty one; so does a text that goes whole.
    * Texts with fewer words than ``length`` keep all of them.
    * Rows with equal doc_id count as documents in text order, those without one come first;
      of equal rows the first is kept.
    * All columns of ``docs`` are handed on; own columns n_words and n_removed replace
      columns of these names. No rows: no result.
    """
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rows = numbered(packed(docs, "doc_id", "text"))
    runs = repeated_runs(rows.select("_n", "text"), length, start)

    @F.pandas_udf("text string, n_words long, n_removed long")
    def cut_down(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            parts = [keep_words(A.encode(t), r) for t, r in zip(texts, lists)]
            yield pd.DataFrame({"text": [p[0].decode("utf-8", "replace") for p in parts], "n_words": [p[1] for p in parts], "n_removed": [p[2] for p in parts]})

    done = _with_runs(rows, runs, "left").withColumn("kept", cut_down.asNondeterministic()("text", "runs"))
    return unpacked(done, columns, "doc_id", text=F.col("kept.text"), n_words=F.col("kept.n_words"), n_removed=F.col("kept.n_removed"))
