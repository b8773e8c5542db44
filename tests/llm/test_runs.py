"""Periodic runs against a plain scan of every lag."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from tablewright.llm import arrays, periodic_runs
from tablewright.llm.queries import QUERIES


def plain_runs(words, shortest=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_report(doc_id, text, looping):
    words = brute.words(text)
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if looping and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *numbers, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    words = [rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH"[: rng.choice([1, 2, 3, 5, 30])]) for _ in range(rng.randint(0, 120))]
    if len(words) > 20 and rng.random() < 0.6:
        p, a = rng.randint(1, 9), rng.randrange(len(words) - 10)
        for i in range(a, min(len(words), a + rng.randint(5, 60))):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("rounds, anchors", [(12, 1 << 18), (1, 40), (0, 1)])
def test_runs_of_many_texts(monkeypatch, rounds, anchors):
    """Splitting by rounds or from the ends, and lags in small or large lots, give the plain result."""
    monkeypatch.setattr(periodic_runs, "ANCHORS", anchors)
    split = periodic_runs.segments
    monkeypatch.setattr(periodic_runs, "segments", lambda words, bounds, shortest: split(words, bounds, shortest, rounds))
    rng = random.Random(rounds)
    for _ in range(60):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        _, _, _, words, first = arrays.block_words([" ".join(t).encode() for t in texts])
        for got, text in zip(periodic_runs.runs_of(words, first), texts, strict=True):
            assert [tuple(r) for r in got.tolist()] == sorted(plain_runs(text), key=lambda r: (r[0], r[2]))


def test_segments_hold_no_single_word():
    words = np.array([hash(c) & 0xFFFFFFFF for c in "abababcabcabdefgdefg" * 2 + "xyz" + "ab" * 9], np.uint64)
    pieces = periodic_runs.segments(words, np.array([0, len(words)]), 4)
    assert len(pieces)
    for a, b in pieces:
        assert np.unique(words[a:b], return_counts=True)[1].min() >= 2


@pytest.mark.parametrize("words", [["the"] * 60_000, ["a", "b", "c"] * 20_000, [f"x{k - j}" for k in range(30_000) for j in (0, 1)]])
def test_long_texts_are_scanned_whole(words):
    """One word over and over, a short period, and a chain of pairs that splits word by word from its end."""
    _, _, _, hashes, first = arrays.block_words([" ".join(words).encode()])
    runs = periodic_runs.runs_of(hashes, first)[0].tolist()
    assert runs == {"the": [[0, 60_000, 1]], "a": [[0, 60_000, 3]]}.get(words[0], [])


def test_documents(spark):
    rng = random.Random(5)
    rows = [r[:2] for r in brute.corpus() if r[1] is None or len(r[1]) < 5000] + [(1000 + i, " ".join(random_words(rng))) for i in range(60)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, `length` string, runs int").repartition(3)
    for looping in (False, True):
        out = periodic_runs.detect_runs(docs, looping=looping)
        got = [(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"],
                hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"]).encode()).hexdigest(),
                hashlib.sha256(r["text"].encode()).hexdigest()) for r in out.collect()]
        brute.alike(got, [plain_report(*r, looping) for r in rows])
    assert periodic_runs.detect_runs(docs.where("doc_id < 0")).count() == 0


def test_registered_query(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(random_words(rng))) for i in range(120)] + [(200, None), (201, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    brute.alike(QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect(), [plain_report(*r, True) for r in rows])
