"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003).

Every text is hashed in rolling grams of ``gram`` code points; of each run of ``window``
grams the smallest hash is kept, the rightmost on ties, with its position. Two texts that
share ``gram + window - 1`` code points share at least one kept gram. A text with less than
a window of grams keeps its smallest one, and one shorter than a gram is a gram itself; so
all lengths follow one rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.arrays import BLOCK_BYTES, mix64, sliding_argmin, twice

GRAM = 8  # a power of two: gram hashes are built by doubling
WINDOW = 16
# Digits of a fingerprint's text, six bits each, and how many of them write a hash.
DIGITS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)
HASH_DIGITS = 10
# Code points hashed at once; the arrays of a block stay below some tens of megabytes.
BLOCK_CHARS = 1 << 19
_LOWEST = -(1 << 63)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes, of as many bits as ``HASH_DIGITS`` write, of all grams of a code point array."""
    out, n = mix64(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)), 1
    while n < gram:
        out, n = twice(out, n), 2 * n
    return mix64(out) >> np.uint64(64 - 6 * HASH_DIGITS)


def _short(points: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of a text with less than a window of grams: its smallest gram, or itself as one gram."""
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(points) < gram:
        points = np.concatenate([points, np.full(gram - len(points), 0x110000, np.uint32)])
    grams = rolling(points, gram)
    at = len(grams) - 1 - int(np.argmin(grams[::-1]))
    return grams[at: at + 1], np.array([at], np.int64)


def _long(points: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of one text in blocks that overlap by a window, so memory stays bounded."""
    hashes, places = [], []
    span = gram + window - 2
    for low in range(0, len(points) - span, BLOCK_CHARS):
        grams = rolling(points[low: low + BLOCK_CHARS + span], gram)
        at = np.unique(sliding_argmin(grams, window, rightmost=True))
        hashes.append(grams[at])
        places.append(at + low)
    at, keep = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(hashes)[keep], at


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of every text, positions ascending. Texts are hashed together in blocks."""
    out: list = [None] * len(texts)
    span = gram + window - 2
    group: list[int] = []
    size = 0

    def flush() -> None:
        points = code_points("".join(texts[i] for i in group))
        ends = np.cumsum([len(texts[i]) for i in group])
        grams = rolling(points, gram)
        at = sliding_argmin(grams, window, rightmost=True)
        owner = np.searchsorted(ends, np.arange(len(at)), "right")
        kept = at[np.arange(len(at)) + span < ends[owner]]  # windows inside one text
        kept = kept[np.diff(kept, prepend=-1) != 0]
        cuts = np.searchsorted(kept, ends)
        low = 0
        for i, end, cut in zip(group, ends, cuts):
            mine = kept[low:cut]
            out[i] = grams[mine], mine - (end - len(texts[i]))
            low = cut

    for i, text in enumerate(texts):
        if len(text) <= span:
            out[i] = _short(code_points(text), gram)
        elif len(text) > BLOCK_CHARS:
            out[i] = _long(code_points(text), gram, window)
        else:
            if size + len(text) > BLOCK_CHARS:
                flush()
                group, size = [], 0
            group.append(i)
            size += len(text)
    if group:
        flush()
    return out


def as_text(fingerprint: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> str:
    """Per kept gram ``HASH_DIGITS`` of its hash and the digits of its distance from the kept gram before.

    No two kept grams are further apart than a window, so one digit is enough for windows
    of up to 64 grams; a first distance is counted from -1.
    """
    hashes, at = fingerprint
    gaps = np.diff(at, prepend=-1) - 1
    wide = gap_digits(window)
    out = np.empty((len(hashes), HASH_DIGITS + wide), np.uint8)
    for j in range(HASH_DIGITS):
        out[:, j] = DIGITS[(hashes >> np.uint64(6 * (HASH_DIGITS - 1 - j)) & np.uint64(63)).astype(np.int64)]
    for j in range(wide):
        out[:, HASH_DIGITS + j] = DIGITS[gaps >> 6 * (wide - 1 - j) & 63]
    return out.tobytes().decode("ascii")


def gap_digits(window: int) -> int:
    return max(1, -(-(max(1, window - 1)).bit_length() // 6))


def from_text(text: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint's text."""
    value = np.zeros(128, np.int64)
    value[DIGITS] = np.arange(64)
    wide = gap_digits(window)
    rows = value[np.frombuffer(text.encode("ascii"), np.uint8)].reshape(-1, HASH_DIGITS + wide)
    hashes, gaps = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
    for j in range(HASH_DIGITS):
        hashes = hashes << np.uint64(6) | rows[:, j].astype(np.uint64)
    for j in range(wide):
        gaps = gaps << 6 | rows[:, HASH_DIGITS + j]
    return hashes, np.cumsum(gaps + 1) - 1


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the kept hashes; 1 for two empty fingerprints."""
    x, y = np.unique(a[0]), np.unique(b[0])
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_table(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, hashes array<long>, positions array<long>) per row of ``docs``; a null text is empty."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in _slices(frame):
                texts = [t if isinstance(t, str) else "" for t in rows["text"]]
                marks = fingerprints(texts, gram, window)
                yield pd.DataFrame({"doc_id": rows["doc_id"], "n_chars": [len(t) for t in texts],
                                    "hashes": [h.view(np.int64) for h, _ in marks], "positions": [p for _, p in marks]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Runs of rows of about ``BLOCK_BYTES`` characters."""
    sizes = np.cumsum([len(t) if isinstance(t, str) else 0 for t in frame["text"]])
    low = 0
    while low < len(frame):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BLOCK_BYTES, "right")))
        yield frame.iloc[low:high]
        low = high


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range followed by the first row of the next one.

    Bounds and first ids are one value per range. Ranges follow each other in (range,
    trailer, doc_id, text) order inside a partition, so a row's successor is the next row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    rows = docs.select("doc_id", "text", key.alias("_key"))
    shares = [i / (4 * parts) for i in range(1, 4 * parts)]
    bounds = sorted({int(b) for b in docs.select(key.alias("_key")).approxQuantile("_key", shares, 1 / (8 * parts))})
    place = F.lit(0)
    if bounds:
        place = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= F.col("_key")))
    rows = rows.withColumn("_range", place)
    heads = sorted((r["_range"], r["head"]) for r in rows.groupBy("_range").agg(F.min("_key").alias("head")).collect())
    if not heads:
        return rows.withColumn("_trailer", F.lit(0))
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    targets = spark.createDataFrame([(h, b) for h, b in before.items()], "_key long, _range int")
    trailers = (rows.drop("_range").where(F.col("_key").isin(list(before))).join(F.broadcast(targets), "_key")
                .select("doc_id", "text", "_key", "_range", F.lit(1).alias("_trailer")))
    return (rows.withColumn("_trailer", F.lit(0)).select("doc_id", "text", "_key", "_range", "_trailer").union(trailers)
            .repartition(parts, "_range").sortWithinPartitions("_range", "_trailer", "_key", "text"))


def compare_with_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness (``RESULT``).

    The edited text is the text with its last half replaced by the beginning of the next
    document's text in ascending doc_id order; after the last comes the first.

    * A null text is empty: no fingerprint; two empty fingerprints are alike (1.0).
    * Null doc_ids come first; rows with equal doc_id follow each other in text order, and
      each of them yields a row. A single row is its own successor. No rows: no result.
    * A text shorter than a gram is one gram; one with less than a window of grams keeps one.
    * Every text is read whole, and so is its edited text. Rows are handed on by ``BLOCK_BYTES``
      characters, and a fingerprint's text is about 1.3 characters for one of its text.
    * Other columns of ``docs`` are not read.
    """
    def finish(rows: list[tuple]) -> pd.DataFrame:
        ids, texts, following, mine, theirs = zip(*rows)
        changed = [edited(a, b) for a, b in zip(texts, following)]
        marks = fingerprints(list(changed), gram, window)
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed],
            "fingerprint": [as_text(m, window) for m in mine], "edited_fingerprint": [as_text(m, window) for m in marks],
            "near_edited": [likeness(m, e) for m, e in zip(mine, marks)], "near_next": [likeness(m, t) for m, t in zip(mine, theirs)],
        })

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the row that still waits for its successor
        for frame in frames:
            for part in _slices(frame):
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                marks, done = fingerprints(texts, gram, window), []
                for low, space, trailer, text, mark in zip(part["_key"], part["_range"], part["_trailer"], texts, marks):
                    if held is not None and held[1] == space:
                        done.append((held[0], held[2], text, held[3], mark))
                    # Of several trailers only the first is a successor.
                    held = None if trailer else (None if low == _LOWEST else low, space, text, mark)
                if done:
                    yield finish(done)

    return _neighbours(docs).select("_key", "_range", "_trailer", "text").mapInPandas(run, RESULT)
