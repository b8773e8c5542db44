"""Spectral clustering on the graph of nearest neighbours, from coarse graphs to fine ones.

The affinity is an edge table. Its nodes are drawn together along strong edges, level by
level, until a small graph is left whose leading eigenvectors the driver computes. On the
way back every level takes over the vectors of the level above and improves them by block
iteration: blocks of edges are joined to the vectors, summed per node, and made orthonormal
again through their small Gram matrix. A graph that is small from the start has one level.

Nodes are numbered in the order of their points, so the edges of a range of nodes lead to
few others: each range holds its edges as one block and asks once for what it needs of a node.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.blocks import distances, matrix
from tablewright.functions.vectors import as_array
from tablewright.operators.lookup import lookup
from tablewright.operators.neighbour_graph import neighbour_edges
from tablewright.operators.ordering import with_position
from tablewright.runtime import cut

# Nodes of the graph whose matrix is decomposed (32 MB).
COARSE = 2_000
# One node in so many becomes the centre of a coarser one.
CENTRES = 4
# An edge is strong enough to be drawn together from this share of its node's strongest one.
STRONG = 0.25
# Nodes whose edges make a block, about; fewer if each has more than ten neighbours.
BLOCK_NODES = 16_384
# Block iterations on every finer level.
STEPS = 2
# Weight of edges that only keep a graph connected, relative to its usual ones.
FAINT = 1e-6


def _merged(u: np.ndarray, v: np.ndarray, a: np.ndarray, total=np.add) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in the order of their ends, equal ones as one."""
    order = np.lexsort((a, v, u))
    u, v, a = u[order], v[order], a[order]
    first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    return u[first], v[first], total.reduceat(a, first)


def _packed(edges: DataFrame, shift: int, total=np.add) -> DataFrame:
    """(block, u, v, a): the edges (u, v, a) of 2 to the ``shift`` node numbers in one row, as bytes, equal ones as one."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, a = _merged(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["a"].to_numpy(), total)
        return pd.DataFrame({"block": [int(u[0]) >> shift], "u": [u.tobytes()], "v": [v.tobytes()], "a": [a.tobytes()]})

    return cut(edges.withColumn("block", F.shiftright("u", shift)).groupBy("block").applyInPandas(pack, "block long, u binary, v binary, a binary"), "edges")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.u, np.int64), np.frombuffer(row.v, np.int64), np.frombuffer(row.a)


def _edge_rows(packed: DataFrame) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                yield pd.DataFrame(dict(zip("uva", _unpacked(row))))

    return packed.mapInPandas(rows, "u long, v long, a double")


def _asked(packed: DataFrame) -> DataFrame:
    """(block, id): the nodes at either end of a block's edges."""
    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                u, v, _ = _unpacked(row)
                yield pd.DataFrame({"id": np.union1d(u, v)}).assign(block=row.block)

    return cut(packed.mapInPandas(ends, "id long, block long"), "asked")


def _meet(packed: DataFrame, asked: DataFrame, values: DataFrame, run, schema: str) -> DataFrame:
    """``run(u, v, a, ids, rows)`` for every block with the ``values(id, ...)`` of its nodes, rows in the order of ids."""
    def each(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return run(*_unpacked(next(edges.itertuples())), rows["id"].to_numpy(), rows)

    return packed.groupBy("block").cogroup(asked.join(values, "id").groupBy("block")).applyInPandas(each, schema)


def affinity_graph(points: DataFrame, affinity: str, gamma: float, n_neighbors: int, shift: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, loop, degree, w, x) and blocks of edges, both ways, of ``points(pid, x, w)``.

    ``n_neighbors`` counts the point itself. A point of weight w stands for w equal rows; the
    affinities among those are its loop. ``rbf`` edges weigh exp(-gamma d^2), the others 1,
    or half if only one end counts the other among its neighbours.
    """
    found = neighbour_edges(points.select("pid", "x", "w"), max(1, n_neighbors - 1), carried=("w",), distinct=True)
    weight = F.greatest(F.exp(-gamma * F.col("d") * F.col("d")), F.lit(1e-12)) if affinity == "rbf" else F.lit(0.5)
    masses = points.select(F.col("pid").alias("u"), F.col("w").cast("double").alias("w1"))
    one_way = found.join(masses, "u").select("u", "v", (weight * F.col("w1") * F.col("w")).alias("a"))
    both = one_way.select(F.inline(F.array(F.struct("u", "v", "a"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "a"))))
    edges = _packed(both, shift, np.maximum if affinity == "rbf" else np.add)
    nodes = points.select(F.col("pid").alias("id"), (F.col("w") * (F.col("w") - 1)).cast("double").alias("loop"), F.col("w").cast("double").alias("w"), "x")
    return _with_degrees(nodes, edges), edges


def _with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                u, _, a = _unpacked(row)
                ids, first = np.unique(u, return_index=True)
                yield pd.DataFrame({"u": ids, "_sum": np.add.reduceat(a, first)})

    sums = edges.mapInPandas(add, "u long, _sum double")
    out = nodes.join(sums, F.col("id") == F.col("u"), "left").withColumn("degree", F.col("loop") + F.coalesce("_sum", F.lit(0.0)))
    return cut(out.select("id", "loop", F.greatest("degree", F.lit(1e-300)).alias("degree"), "w", "x"), "nodes")


def _hashed(ids: np.ndarray, level: int) -> np.ndarray:
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ties(edges: DataFrame, level: int) -> DataFrame:
    """(id, own, top): a node's centre, if it is one or has a strong edge to one, and the node of its strongest edge."""
    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                u, v, a = _unpacked(row)
                mixed = _hashed(v, level)
                order = np.lexsort((mixed, a, u))
                u, v, a, centre = u[order], v[order], a[order], (mixed % np.uint64(CENTRES) == 0)[order]
                last = np.flatnonzero(np.r_[u[1:] != u[:-1], True])
                ids, top, most = u[last], v[last], a[last]
                strong = centre & (a >= STRONG * most[np.searchsorted(ids, u)])
                cu, cv = u[strong], v[strong]
                end = np.flatnonzero(np.r_[cu[1:] != cu[:-1], True][:len(cu)])
                own = pd.Series(pd.NA, index=ids, dtype="Int64")
                own[cu[end]] = cv[end]
                itself = ids[_hashed(ids, level) % np.uint64(CENTRES) == 0]
                own[itself] = itself
                yield pd.DataFrame({"id": ids, "own": own.array, "top": top})

    return edges.mapInPandas(choose, "id long, own long, top long")


def _mean(width: int) -> Column:
    return F.array(*[F.sum(F.col("x")[j] * F.col("w")) / F.sum("w") for j in range(width)])


def coarsen(nodes: DataFrame, edges: DataFrame, asked: DataFrame, level: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parents (id, parent), nodes without degrees, edges as rows) of the next coarser graph.

    Some nodes, chosen by hash, are centres. Every other node goes to the centre it has its
    strongest edge to, if that edge is strong for it; otherwise it follows the node of its
    strongest edge to that one's centre. Two that are left with each other make a pair, others
    stay by themselves. Edges of nodes to themselves weigh 0; they keep nodes without others in their blocks.
    """
    ties = cut(_ties(edges, level), "ties")
    left = ties.where("own is null").select("id", "top")
    followed = left.join(ties.select(F.col("id").alias("top"), F.col("own").alias("_own"), F.col("top").alias("_back")), "top")
    pair = F.when(F.col("_back") == F.col("id"), F.least("id", "top"))
    chosen = ties.where("own is not null").select("id", F.col("own").alias("parent")).union(followed.select("id", F.coalesce("_own", pair)))
    parents = cut(nodes.select("id").join(chosen, "id", "left").select("id", F.coalesce("parent", "id").alias("parent")), "parents")

    def rename(u, v, a, ids, rows):
        parent = rows["parent"].to_numpy()
        return pd.DataFrame(dict(zip("uva", _merged(parent[np.searchsorted(ids, u)], parent[np.searchsorted(ids, v)], a))))

    joint = cut(_meet(edges, asked, parents, rename, "u long, v long, a double"), "joint")
    inner = joint.where("u = v").groupBy(F.col("u").alias("parent")).agg(F.sum("a").alias("inner"))
    merged = nodes.join(parents, "id").groupBy("parent").agg(F.sum("loop").alias("loop"), _mean(width).alias("x"), F.sum("w").alias("w"))
    merged = merged.join(inner, "parent", "left").select(
        F.col("parent").alias("id"), (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop"), "w", "x")
    return parents, merged, joint.withColumn("a", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col("a")))


def _relinked(nodes: DataFrame, edges: DataFrame, k: int, shift: int) -> DataFrame:
    """More edges, faint ones, between nodes and those nearest to them, where no edges are left to draw together along."""
    near = neighbour_edges(nodes.select(F.col("id").alias("pid"), "x"), k)
    first = near.groupBy("u").agg(F.min("d").alias("d0"))
    faint = near.join(first, "u").join(nodes.select(F.col("id").alias("u"), "degree"), "u").select(
        "u", "v", (FAINT * F.col("degree") * F.pow(F.try_divide(F.col("d0"), F.col("d")), F.lit(2))).alias("a"))
    faint = faint.union(faint.select(F.col("v").alias("u"), F.col("u").alias("v"), "a"))
    return _packed(_edge_rows(edges).union(faint), shift)


def _bridges(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Faint affinities along the shortest lines that make a small graph connected."""
    above = np.arange(len(a))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return int(i)

    for i, j in zip(*np.nonzero(np.triu(a))):
        above[top(i)] = top(j)
    label = np.array([top(i) for i in range(len(a))])
    out = np.zeros_like(a)
    if len(set(label.tolist())) > 1:
        d = distances(x, x)
        i, j = np.nonzero(np.triu(label[:, None] != label[None, :]))
        order = np.argsort(d[i, j], kind="stable")
        least, usual = None, np.median(a[a > 0]) if (a > 0).any() else 1.0
        for u, v in zip(i[order].tolist(), j[order].tolist()):
            if top(u) != top(v):
                above[top(u)] = top(v)
                least = least or max(d[u, v], 1e-300)
                out[u, v] = out[v, u] = FAINT * usual * (least / max(d[u, v], 1e-300)) ** 2
    return out


def _leading(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """(id, v0, ...): the leading eigenvectors of a small graph."""
    rows = nodes.orderBy("id").toPandas()
    at = {int(i): n for n, i in enumerate(rows["id"])}
    a = np.zeros((len(rows), len(rows)))
    for r in edges.collect():  # at most COARSE squared edges, in blocks
        for u, v, each in zip(*(t.tolist() for t in _unpacked(r))):
            a[at[u], at[v]] = each
    a = (a + a.T) / 2
    a += _bridges(a, matrix(rows["x"], 1))
    a[np.diag_indices_from(a)] = rows["loop"]
    scale = 1.0 / np.sqrt(np.maximum(a.sum(axis=1), 1e-300))
    _, vectors = np.linalg.eigh(scale[:, None] * a * scale[None, :])
    schema = "id long, " + ", ".join(f"{c} double" for c in _names(k))
    return nodes.sparkSession.createDataFrame([(int(i), *[float(t) for t in v]) for i, v in zip(rows["id"], vectors[:, -k:])], schema)


def _names(k: int) -> list[str]:
    return [f"v{j}" for j in range(k)]


def _orthonormal(vectors: DataFrame, k: int) -> DataFrame:
    """``vectors(id, loop, degree, v0, ...)`` with columns of length one at right angles, by the inverse root of the Gram matrix."""
    v = [F.col(c) for c in _names(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = vectors.agg(*[F.sum(v[i] * v[j]) for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for (i, j), s in zip(pairs, sums):
        gram[i, j] = gram[j, i] = s or 0.0
    values, basis = np.linalg.eigh(gram)
    root = basis / np.sqrt(np.maximum(values, max(values.max(), 1e-300) * 1e-14))
    turned = [sum((v[i] * float(root[i, j]) for i in range(k)), F.lit(0.0)).alias(c) for j, c in enumerate(_names(k))]
    return vectors.select("id", "loop", "degree", *turned)


def _improved(vectors: DataFrame, edges: DataFrame, asked: DataFrame, k: int, steps: int) -> DataFrame:
    """Some block iterations with half the normalised affinity plus half the identity, whose spectrum is not negative."""
    names = _names(k)

    def step(u, v, a, ids, rows):
        loop, degree, x = rows["loop"].to_numpy(), rows["degree"].to_numpy(), rows[names].to_numpy()
        root = np.sqrt(degree)[:, None]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        sums = np.add.reduceat((x / root)[np.searchsorted(ids, v)] * a[:, None], first, axis=0)
        own = np.searchsorted(ids, u[first])
        moved = (x[own] * (1 + loop / degree)[own, None] + sums / root[own]) / 2
        return pd.DataFrame(moved, columns=names).assign(id=u[first], loop=loop[own], degree=degree[own])

    schema = "id long, loop double, degree double, " + ", ".join(f"{c} double" for c in names)
    for _ in range(steps):
        vectors = _orthonormal(cut(_meet(edges, asked, vectors, step, schema), "vectors"), k)
    return vectors


def embedding(points: DataFrame, k: int, gamma: float, affinity: str, n_neighbors: int, coarse: int = COARSE, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(id, v): leading eigenvectors of the normalised affinity of ``points(pid, x, w)``, pid from 0."""
    width, n = len(points.first().x), points.count()
    held = max(1, block_nodes * 10 // max(10, n_neighbors))
    spaced = lambda m: max(0, int(np.log2(held * n / m)))  # noqa: E731  # numbers thin out as nodes are drawn together
    nodes, edges = affinity_graph(points, affinity, gamma, n_neighbors, spaced(n))
    levels, m, tries = [], n, 0
    while m > coarse:
        tries += 1
        asked = _asked(edges)
        parents, merged, joint = coarsen(nodes, edges, asked, tries, width)
        above = parents.where("id = parent").count()
        if above > 0.9 * m:  # nodes without edges: each that has one goes to a centre with a chance of 1 in CENTRES
            edges = _relinked(nodes, edges, n_neighbors, spaced(m))
            nodes = _with_degrees(nodes.drop("degree"), edges)
            continue
        levels.append((parents, nodes, edges, asked))
        m = above
        edges = _packed(joint, spaced(m))
        nodes = _with_degrees(merged, edges)
    vectors = _leading(nodes, edges, k).join(nodes.select("id", "loop", "degree"), "id")
    for parents, finer, edges, asked in reversed(levels):
        up = vectors.select(F.col("id").alias("parent"), *[(F.col(c) / F.sqrt("degree")).alias(c) for c in _names(k)])
        down = finer.join(parents, "id").join(up, "parent").select("id", "loop", "degree", *[(F.col(c) * F.sqrt("degree")).alias(c) for c in _names(k)])
        vectors = _improved(down, edges, asked, k, STEPS)
    return vectors.select("id", F.array(*_names(k)).alias("v"))


def spectral(df: DataFrame, id_column: str, features, n_clusters: int = 8, n_components: int | None = None, gamma: float = 1.0,
             affinity: str = "rbf", n_neighbors: int = 10, n_init: int = 10, seed: int = 42, coarse: int = COARSE) -> DataFrame:
    """(id, cluster) by KMeans on the leading eigenvectors of the normalised affinity of nearest neighbours.

    ``n_neighbors`` are kept of every point, itself counted, for either affinity. Graphs of
    more than ``coarse`` nodes go through coarser ones; parts without edges between them are
    told apart by how far they lie from each other.
    """
    if affinity not in ("rbf", "nearest_neighbors"):
        raise ValueError(f"unsupported affinity {affinity!r}: choose rbf or nearest_neighbors")
    given = df.select(F.col(id_column).alias("id"), as_array(df, features).alias("x"))
    distinct = cut(given.groupBy("x").agg(F.count(F.lit(1)).alias("w")), "distinct")
    points = cut(with_position(distinct, ["x"], "pid"), "points")
    vectors = embedding(points, n_components or n_clusters, gamma, affinity, n_neighbors, coarse)
    unit = F.transform("v", lambda t: t / F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, u: s + u * u)), F.lit(1e-300)))
    ready = points.join(vectors, F.col("pid") == F.col("id")).select("x", F.col("w").cast("double").alias("w"), array_to_vector(unit).alias("features"))
    ready = cut(ready, "embedded")
    best = None
    for i in range(max(1, n_init)):
        model = KMeans(k=n_clusters, seed=seed + i, maxIter=100, weightCol="w").fit(ready)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    labels = best.transform(ready).select("x", F.col("w").alias("n"), F.col("prediction").cast("long").alias("cluster"))
    return lookup(given, labels, "x", "x", "cluster").select(F.col("id").alias(id_column), "cluster")
