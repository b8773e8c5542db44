"""Shingle sets and circulant MinHash signatures of whole batches of texts."""

from __future__ import annotations

import numpy as np

from tablewright.llm import arrays as A

SHINGLE = 5
COORDINATES = 128
ROWS = 4  # coordinates in a band
_FIRST = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after another, and where each text begins.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle; one without words has none.
    """
    _, _, _, words, first = A.block_words(texts, lower=True)
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), sizes)
    grams = A.gram_hashes(words, shingle)
    inside = doc[: len(grams)] == doc[shingle - 1:] if len(grams) else np.empty(0, bool)
    few = np.flatnonzero((sizes > 0) & (sizes < shingle))
    owners, values = [doc[: len(grams)][inside]], [A.mix64(grams[inside])]
    for size in np.unique(sizes[few]):
        some = few[sizes[few] == size]
        # Sequences of different lengths are different sets even if their hashes agree.
        values.append(A.mix64(A.mix64(A.gram_hashes(words, size)[first[some]]) + np.uint64(size)))
        owners.append(some)
    owner, value = np.concatenate(owners), np.concatenate(values)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def _second(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def signatures(values: np.ndarray, first: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Circulant MinHash (Li and Li 2022): (texts, coordinates) of 32-bit minima.

    A first permutation scatters the shingles over 32-bit places. Coordinate k takes the
    smallest value that a second permutation, shifted round by k places, gives them. Texts
    without shingles keep the largest value.
    """
    places = (A.mix64(values * _FIRST) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first))
    out = np.full((len(first) - 1, coordinates), 0xFFFFFFFF, np.uint32)
    if len(full):
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(_second(places + np.uint32(k)), first[full])
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) of 64-bit keys, each from ``rows`` coordinates and the band's number."""
    bands = signature.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        key = A.mix64(key * _FIRST + signature[:, j:: rows][:, :bands].astype(np.uint64))
    return key


def set_hashes(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set, equal for equal sets; 0 for empty ones."""
    out = []
    for salt in (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(A.mix64(values ^ salt), out=sums[1:])
        out.append(sums[first[1:]] - sums[first[:-1]])
    return out[0], out[1]
