"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run of period q that is at least 2 q words long holds each of its words twice or more. So
a word that occurs once within a segment is in no run inside it: it splits the segment, and
the parts are looked at anew until nothing splits. What survives and is long enough is
scanned at every lag. Words that agree with those q further on, q of them in a row or more,
include one at a multiple of q from the segment's start. So lag q compares every q-th word,
n / q of them, and all lags together n log n; what agrees is extended both ways by comparing
hashes of doubled lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm import arrays as A

SHORTEST = 12
# A run holds its period at least so often, and so each of its words.
REPEATS = 2
# Rounds in which all segments split at once, before each is split from its ends.
ROUNDS = 12
# Anchors compared at once, about.
ANCHORS = 1 << 18


def looped(n: int, key: str) -> np.ndarray:
    """Which original word stands at each of ``n`` places: one text in ten repeats a piece of itself to its end."""
    h = zlib.crc32(key.encode())
    at = np.arange(n)
    if h % 10 or n == 0:
        return at
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at[a:] = a + (at[a:] - a) % p
    return at


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the same word before (or -1) and after (or the number of words)."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    same = words[order[1:]] == words[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _split_from_ends(low: int, high: int, before: np.ndarray, after: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Parts of one segment in which every word occurs twice.

    Looks for a single word from both ends at once, so a split costs the length of its
    smaller part, and all splits n log n.
    """
    open_, done = [(low, high)], []
    while open_:
        a, b = open_.pop()
        if b - a < shortest:
            continue
        for step in range((b - a + 1) // 2):
            for i in (a + step, b - 1 - step):
                if before[i] < a and after[i] >= b:
                    open_ += [(a, i), (i + 1, b)]
                    break
            else:
                continue
            break
        else:
            done.append((a, b))
    return done


def segments(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST, rounds: int = ROUNDS) -> np.ndarray:
    """(start, end) of the maximal pieces whose words all occur ``REPEATS`` times in them.

    ``bounds`` are the borders of texts, which no piece crosses; ``words`` of different
    texts have to differ.
    """
    before, after = neighbours(words)
    live = np.stack([bounds[:-1], bounds[1:]], axis=1)
    live = live[live[:, 1] - live[:, 0] >= shortest]
    stable = []
    for _ in range(rounds):
        if not len(live):
            break
        sizes = live[:, 1] - live[:, 0]
        seg = np.repeat(np.arange(len(live)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(live[:, 0] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        single = (before[at] < live[seg, 0]) & (after[at] >= live[seg, 1])
        torn = np.zeros(len(live), bool)
        torn[seg[single]] = True
        stable.append(live[~torn])
        cuts, owners = at[single], seg[single]
        # The parts of a torn segment lie between its start, its single words and its end.
        owner = np.concatenate([np.flatnonzero(torn), owners])
        starts = np.concatenate([live[torn, 0], cuts + 1])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = live[owner, 1]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ends[inner] = starts[inner + 1] - 1
        live = np.stack([starts, ends], axis=1)
        live = live[live[:, 1] - live[:, 0] >= shortest]
    for low, high in live.tolist():
        stable.append(np.array(_split_from_ends(low, high, before, after, shortest), np.int64).reshape(-1, 2))
    return np.concatenate(stable) if stable else np.empty((0, 2), np.int64)


class _Hashes:
    """Hashes of all pieces of a word sequence whose length is a power of two, made when asked for."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            self.levels.append(A.mix64(A.twice(self.levels[-1], 1 << (len(self.levels) - 1))))
        return self.levels[k]

    def common(self, left: np.ndarray, right: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
        """Words that agree from ``left`` and ``right`` (left < right) on, at most ``room``.

        Backward, the words before the two places are compared.
        """
        out = np.zeros(len(left), np.int64)
        # Double the step while whole steps agree, then halve it.
        k, grows = 0, np.ones(len(left), bool)
        reached = np.zeros(len(left), np.int64)
        while grows.any():
            some = np.flatnonzero(grows)
            agree = self._agree(left[some], right[some], out[some], room[some], k, forward)
            out[some[agree]] += 1 << k
            reached[some] = k
            grows[some[~agree]] = False
            k += 1
        for k in range(int(reached.max(initial=0)), -1, -1):
            some = np.flatnonzero(reached >= k)
            agree = self._agree(left[some], right[some], out[some], room[some], k, forward)
            out[some[agree]] += 1 << k
        return out

    def _agree(self, left, right, done, room, k: int, forward: bool) -> np.ndarray:
        size = 1 << k
        fits = done + size <= room
        out = np.zeros(len(left), bool)
        if fits.any():
            row = self.level(k)
            a, b = (left + done, right + done) if forward else (left - done - size, right - done - size)
            out[fits] = row[a[fits]] == row[b[fits]]
        return out


def _anchors(pieces: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, place, lag): the multiples of every lag of up to half of a piece, about ``most`` at a time."""
    sizes = pieces[:, 1] - pieces[:, 0]
    half = sizes // 2
    owner = np.repeat(np.arange(len(pieces)), half)
    lag = np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half) + 1
    counts = (sizes[owner] - 1 - lag) // lag + 1
    total = np.cumsum(counts)
    low = 0
    while low < len(lag):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        n = counts[low:high]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        each, own = np.repeat(lag[low:high], n), np.repeat(owner[low:high], n)
        yield own, pieces[own, 0] + step * each, each
        low = high


def lag_scan(words: np.ndarray, pieces: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) of all runs within the pieces (start, end) that survived, by start, then period."""
    hashes, found = _Hashes(words), [np.empty((0, 3), np.int64)]
    # End and period of a long run around every word: there, multiples of its period find it again.
    end, period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    for own, at, lag in _anchors(pieces, ANCHORS):
        hit = np.flatnonzero((words[at] == words[at + lag]) & ((at + lag >= end[at]) | (lag % period[at] != 0)))
        at, lag, own = at[hit], lag[hit], own[hit]
        back = hashes.common(at, at + lag, at - pieces[own, 0], forward=False)
        ahead = hashes.common(at, at + lag, pieces[own, 1] - at - lag, forward=True)
        length = back + lag + ahead
        good = length >= np.maximum(shortest, REPEATS * lag)
        runs = np.unique(np.stack([(at - back)[good], length[good], lag[good]], axis=1), axis=0)
        found.append(runs)
        long = runs[runs[:, 1] >= 2 * REPEATS * runs[:, 2]]
        for start, size, q in long[np.lexsort((-long[:, 2], long[:, 1]))].tolist():
            end[start: start + size], period[start: start + size] = start + size, q
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Multiples of a period make the same stretch; the smallest counts.
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(words: np.ndarray, bounds: np.ndarray, shortest: int = SHORTEST) -> list[np.ndarray]:
    """Runs of every text, starts counted within it. ``words`` are hashes; texts lie between ``bounds``."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    salt = A.mix64(np.arange(1, len(bounds), dtype=np.uint64))
    pieces = segments(words ^ salt[owner] if len(words) else words, bounds, shortest)
    found = lag_scan(words, pieces, shortest)
    text = np.searchsorted(bounds, found[:, 0], "right") - 1
    found[:, 0] -= bounds[text]
    return np.split(found, np.searchsorted(text, np.arange(1, len(bounds) - 1)))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


SCHEMA = ("n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs array<struct<start: long, length: long, period: long>>, text string")


def _report(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, runs: np.ndarray) -> tuple:
    stay = kept(len(starts), runs)
    text = b" ".join(raw[s:e].tobytes() for s, e in zip(starts[stay].tolist(), ends[stay].tolist())).decode("utf-8", "replace")
    rows = runs.tolist()
    if not rows:
        return len(starts), 0, None, None, None, None, [], text
    start, length, period = min(rows, key=lambda r: (-r[1], r[0], r[2]))
    return len(starts), len(rows), start, length, period, 1000 * length // period, rows, text


def detect_runs(docs: DataFrame, shortest: int = SHORTEST, looping: bool = False) -> DataFrame:
    """``doc_id``, what ``SCHEMA`` names: the runs of every text by start and period, and the text without repetitions.

    A run is a stretch of consecutive words with smallest period q and at least
    max(``shortest``, 2 q) words that no word beside it extends. start, length and period
    are those of the longest run (ties: smallest start, then period). In ``text`` every run
    keeps its first q words; words are joined by one space. ``looping`` first lets some
    texts, chosen by doc_id, repeat a piece of themselves to their end (see ``looped``).

    * A null or blank text has no words and no runs; its ``text`` is empty.
    * A row without doc_id is not changed by ``looping``. Repeated rows are reported each.
    * Further columns are not read, whatever their names. No rows: no result.
    * Any length is read whole; a text takes time n log n, and n words a few hundred bytes each.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["doc_id"].to_numpy()
            for low, texts in A.text_blocks(frame["text"]):
                own = ids[low: low + len(texts)]
                raw, starts, ends, words, first = A.block_words(texts)
                if looping:
                    place = [looped(b - a, str(int(i))) + a if pd.notna(i) else np.arange(a, b)
                             for i, a, b in zip(own, first[:-1].tolist(), first[1:].tolist())]
                    place = np.concatenate(place)
                    starts, ends, words = starts[place], ends[place], words[place]
                rows = [_report(raw, starts[a:b], ends[a:b], found) for a, b, found in zip(first[:-1], first[1:], runs_of(words, first, shortest))]
                out = pd.DataFrame(rows, columns=["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text"])
                for c in ("start", "length", "period", "exponent_milli"):
                    out[c] = out[c].astype("Int64")
                out["runs"] = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in out["runs"]]
                out.insert(0, "doc_id", pd.array(own, "Int64"))
                yield out

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, {SCHEMA}")



def runs_text(runs: Column) -> Column:
    """``start,length,period`` of every run, each on a line of its own."""
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))))
