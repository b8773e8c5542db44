"""Approximate nearest neighbours: probed lists, scanned dimension block by dimension block.

Vectors get one more coordinate that makes all of them equally long, so the largest inner
product is the smallest distance; then a random rotation spreads a distance evenly over the
coordinates. After each block of rotated columns the partial distance estimates the whole
one, and a candidate whose estimate exceeds a query's bound by more than a test allows is
abandoned (adaptive sampling of dimensions, Gao and Long 2023). What is left is scored
exactly on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.runtime import cut

LISTS = 64
PROBES = 44
# Vectors that the index is fitted on, and how many of them bound a query's k-th nearest.
SAMPLE = 16_384
BOUND_SAMPLE = 4_096
# Numbers the sample may hold; fewer vectors are taken of wider ones.
SAMPLE_CELLS = 2_000_000
# Rotated columns scanned between two tests, and the width of the test.
COLUMNS = 16
EPSILON = 2.1
# Vectors and queries that meet in one task.
LIST_CHUNK = 8_192
QUERY_CHUNK = 16_384
ROUNDS = 10


@dataclass
class Index:
    """Centroids and rotation, fitted on a sample; every vector is then put into a list."""

    width: int
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the coordinate that makes them ``longest`` long."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed coordinate by coordinate."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): one usable vector per non-null id, the largest of several."""
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable(F.col("v")))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> Index | None:
    """Centroids by k-means on a sample taken by hash of the id; the width is the most frequent one."""
    widths = vectors.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)).alias("long"))
    best = widths.orderBy(F.desc("n"), "width").first()
    if best is None:
        return None
    wanted = min(sample, max(256, SAMPLE_CELLS // best["width"]))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    share = int(min(1.0, 1.2 * wanted / best["n"]) * (1 << 30))
    kept = vectors.where((F.size("v") == best["width"]) & (place < share)).orderBy(place, "vec_id").limit(wanted).toPandas()
    x = np.stack(kept["v"].to_numpy()).astype(float)
    longest = float(np.sqrt(best["long"]))
    y, rng = lifted(x, longest), np.random.default_rng(11)
    rotation = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
    lists = max(1, min(lists, len(y) // 16))
    centroids = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(ROUNDS):
        own = _order(y, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, y)
        count = np.bincount(own, minlength=lists)[:, None]
        centroids = np.where(count > 0, sums / np.maximum(count, 1), centroids)
    few = min(BOUND_SAMPLE, len(x))
    return Index(best["width"], longest, rotation, centroids, kept["vec_id"].to_numpy()[:few], x[:few])


def _order(y: np.ndarray, centroids: np.ndarray, first: int) -> np.ndarray:
    """The nearest ``first`` centroids of every row, nearest first."""
    gaps = (centroids**2).sum(axis=1) - 2 * (y @ centroids.T)
    return np.argsort(gaps, axis=1, kind="stable")[:, :first]


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, width))


def assign(vectors: DataFrame, index: Index) -> DataFrame:
    """(list, vec_id, v): the list of the nearest centroid for every vector."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                y = lifted(_matrix(frame["v"], index.width), index.longest)
                yield pd.DataFrame({"list": _order(y, index.centroids, 1)[:, 0], "vec_id": frame["vec_id"], "v": frame["v"]})

    return vectors.where(F.size("v") == index.width).mapInPandas(run, "list int, vec_id long, v array<double>")


def probes(queries: DataFrame, index: Index, filled: list[int], k: int, most: int) -> DataFrame:
    """(list, query_id, q, bound, seen): a row per query and probed list.

    ``bound`` is the score of the k-th nearest in the bounding sample; those k ids go along
    once, so that a query never gets fewer than it could. Only ``filled`` lists are probed.
    """
    filled = np.array(filled, np.int32)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at: at + 256]
                q = _matrix(part["v"], index.width)
                y = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
                near = filled[_order(y, index.centroids[filled], most)]
                seen = q @ index.sample.T
                seen[part["vec_id"].to_numpy()[:, None] == index.sample_ids[None]] = -np.inf
                top = np.argsort(-seen, axis=1)[:, :k]
                bound = np.take_along_axis(seen, top, axis=1)[:, -1] if seen.shape[1] >= k else np.full(len(q), -np.inf)
                n, none = near.shape[1], np.empty(0, np.int64)
                first = [index.sample_ids[t[np.isfinite(row[t])]] for t, row in zip(top, seen)]
                yield pd.DataFrame({"list": near.ravel(), "query_id": np.repeat(part["vec_id"].to_numpy(), n),
                                    "q": [v for v in part["v"] for _ in range(n)], "bound": np.repeat(bound - 1e-9 * (1 + np.abs(bound)), n),
                                    "seen": [ids if i == 0 else none for ids in first for i in range(n)]})

    return queries.where(F.size("v") == index.width).mapInPandas(run, "list int, query_id long, q array<double>, bound double, seen array<long>")


def scan(index: Index, k: int, columns: int, epsilon: float):
    """The scan of one chunk of a list by one chunk of queries."""
    place = {int(v): i for i, v in enumerate(index.sample_ids)}

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, out = own["vec_id"].to_numpy(), []
        if len(own) and len(asked):
            x, q = _matrix(own["v"], index.width), _matrix(asked["q"], index.width)
            rx = lifted(x, index.longest) @ index.rotation
            rq = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ index.rotation
            d = rx.shape[1]
            far = np.maximum((rq * rq).sum(axis=1) + index.longest**2 - 2 * asked["bound"].to_numpy(), 0)
            blocks = [slice(a, min(a + columns, d)) for a in range(0, d, columns)]
            limit = [(b.stop / d) * (1 + epsilon / np.sqrt(b.stop)) ** 2 if b.stop < d else 1 + 1e-9 for b in blocks]
            b = blocks[0]
            norm = (rx[:, b] ** 2).sum(axis=1)
            for low in range(0, len(q), 128):
                some = slice(low, min(low + 128, len(q)))
                part = norm[None] + (rq[some, b] ** 2).sum(axis=1)[:, None] - 2 * (rq[some, b] @ rx[:, b].T)
                keep = part <= far[some, None] * limit[0]
                for i in range(some.start, some.stop):
                    left = np.flatnonzero(keep[i - low])
                    gap = part[i - low, left]
                    for b2, test in zip(blocks[1:], limit[1:]):
                        gap = gap + ((rx[left, b2] - rq[i, b2]) ** 2).sum(axis=1)
                        good = gap <= far[i] * test
                        left, gap = left[good], gap[good]
                    left = left[ids[left] != asked["query_id"].iat[i]]
                    score = exact_scores(x[left], q[i])
                    top = np.lexsort((ids[left], -score))[:k]
                    out.append((np.full(len(top), asked["query_id"].iat[i]), ids[left[top]], score[top]))
        for query_id, q, seen in zip(asked["query_id"], asked["q"], asked["seen"]):
            if len(seen):
                x = index.sample[[place[i] for i in seen]]
                out.append((np.full(len(seen), query_id), np.asarray(seen), exact_scores(x, np.asarray(q, float))))
        parts = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, lists: int = LISTS, most: int = PROBES, columns: int = COLUMNS,
            epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id is divisible by ``every``.

    Nearest is the largest inner product; ties go to the smaller id.

    * Vectors that are null, zero or hold null or non-finite components take no part, nor do
      those of another than the most frequent width, nor rows without an id.
    * Of several rows with one id the largest vector counts. Equal vectors under different
      ids are different candidates. With fewer than ``k`` others all probed ones are returned.
    * No usable vector, or no query: no rows. Further columns are not read.
    * Lists are cut into chunks of vectors and of queries, so neither a crowded list nor
      many queries meet in one task.
    """
    spark = vectors.sparkSession
    clean = cut(clean_vectors(vectors), "vectors")
    index = fit(clean, lists)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    placed = cut(assign(clean, index), "lists")
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = clean.where(F.col("vec_id") % every == 0)
    turns = -(-queries.count() // QUERY_CHUNK) or 1
    chunks = spark.createDataFrame([(i, -(-n // LIST_CHUNK)) for i, n in counts.items()], "list int, _chunks int")
    by_id = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    own = placed.join(F.broadcast(chunks), "list").select("list", by_id("vec_id", F.col("_chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "vec_id", "v")
    asked = (probes(queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "vec_id"), index, sorted(counts), k, most).join(F.broadcast(chunks), "list")
             .select("list", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), by_id("query_id", F.lit(turns)).alias("turn"), "query_id", "q", "bound", "seen"))
    keys = ["list", "chunk", "turn"]
    found = own.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(scan(index, k, columns, epsilon), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
