"""NumPy kernels shared by the text operators: words, hashes and sliding minima of whole batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

# Bytes of text taken through the kernels at once; bounds the memory of a task.
BLOCK_BYTES = 1 << 21
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
# B * _UNBASE == 1 modulo 2**64.
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
# Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def encode(text) -> bytes:
    """UTF-8 of a text, empty for a missing one; lone surrogates become '?', as in Spark."""
    return text.encode("utf-8", "replace") if isinstance(text, str) else b""


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a byte array."""
    letter = np.empty(len(raw) + 2, bool)
    letter[0] = letter[-1] = False
    np.logical_not(_SPACE[raw], out=letter[1:-1])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words given by their byte offsets, in blocks of ``BLOCK_BYTES``."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        up, down = _power_tables(high - low + 1)
        piece = raw[low:high]
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[_LOWER[piece] if lower else piece] * up[: high - low], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hashes of all runs of ``n`` words, at their starts."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    size = len(words) - n + 1
    out = words[:size].copy()
    factor = 1
    for j in range(1, n):
        factor = factor * int(_WORD_BASE) % (1 << 64)
        out += words[j: j + size] * np.uint64(factor)
    return out


def twice(grams: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of ``2 n`` words from those of ``n`` words."""
    if len(grams) <= n:
        return np.empty(0, np.uint64)
    return grams[:-n] + grams[n:] * np.uint64(pow(int(_WORD_BASE), n, 1 << 64))


def sliding_argmin(values: np.ndarray, width: int, rightmost: bool = False) -> np.ndarray:
    """Position of the smallest value in every run of ``width`` values, by doubling the run."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at, length = values, np.arange(len(values)), 1

    def join(step: int, size: int):
        a, b = best[:size], best[step: step + size]
        right = b <= a if rightmost else b < a
        return np.where(right, b, a), np.where(right, at[step: step + size], at[:size])

    while 2 * length <= width:
        best, at = join(length, len(best) - length)
        length *= 2
    if length < width:
        best, at = join(width - length, n)
    return at


def text_blocks(texts: Iterable, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, with the index of the first, up to ``limit`` bytes together (or one text)."""
    first, kept, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = encode(text)
        if kept and size + len(raw) > limit:
            yield first, kept
            first, kept, size = i, [], 0
        kept.append(raw)
        size += len(raw)
    if kept:
        yield first, kept


def block_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts: (bytes, starts, ends, hashes, first word of each text and the total)."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    starts, ends = word_bounds(raw)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return raw, starts, ends, word_hashes(raw, starts, ends, lower), np.searchsorted(starts, offsets)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the longs Spark holds."""
    return np.ascontiguousarray(values).view(np.int64)


def batches(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of at most ``rows`` rows."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at: at + rows]
