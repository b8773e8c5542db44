"""Exact k nearest neighbours between two tables.

A side of checked size goes to every task: the references, or else a few queries,
for which every task keeps its own k nearest. Two large sides are joined by a tree of
pivots whose cells keep their size as the references grow: every point belongs to the cell
of its nearest pivot, a query is first compared with its own cell, and then sent to those
cells only that the ball of its k nearest so far can reach. Crowded cells are cut into
chunks on both sides, so no task's work depends on skew. Where balls reach too many of the
cells, as among points of many columns, large blocks of both sides meet instead.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.functions.blocks import SCREENED_WIDTH, distances, matrix, row_slices, screen, smallest
from tablewright.operators.pivots import PivotTree
from tablewright.runtime import BROADCAST_CELLS, BROADCAST_ROWS, bounded_count, cut, fits_broadcast

CHUNK_ROWS = 8_192
# Up to this many queries are sent to the references instead.
QUERY_ROWS = 4_096
# References in a cell, about; their pivots are sent to every task, so beyond 100,000 of them cells grow.
CELL_ROWS = 1_000
# Some queries are asked first how many cells they reach; with more than this share blocks of so many rows meet.
ASKED_ROWS = 256
REACHED_SHARE = 0.02
BLOCK_ROWS = 32_768


def _top(query_ids, queries, refs: pd.DataFrame, points: np.ndarray, k: int, p: float, qid: str) -> Iterator[pd.DataFrame]:
    """The k nearest ``refs`` of each query; ``refs`` are sorted by id, so ties go to the lowest."""
    fast = screen(points, p) if k <= len(points) else None
    fast = fast if fast and fast.safe(queries) else None
    for part in row_slices(len(queries), len(points)):
        if fast:
            best, near = fast.nearest(queries[part], k)
        else:
            block = distances(queries[part], points, p)
            best = smallest(block, k)
            near = np.take_along_axis(block, best, axis=1)
        flat = best.ravel()
        out = refs.iloc[flat].reset_index(drop=True)
        out.insert(0, qid, np.repeat(query_ids[part], best.shape[1]))
        out["distance"] = near.ravel()
        yield out


def nearest_neighbours(
    queries: DataFrame, references: DataFrame, k: int, p: float = 2.0,
    broadcast_rows: int = BROADCAST_ROWS, query_rows: int = QUERY_ROWS, pivots: int | None = None,
    chunk_rows: int = CHUNK_ROWS, distinct: bool = False,
) -> DataFrame:
    """(qid, rid, ..., distance) for ``queries(qid, x)`` and ``references(rid, x, ...)``.

    Neighbours are ordered by distance, then by ``rid``; p is the Minkowski power. References
    that are all ``distinct`` need not be searched for copies.
    """
    width_row = references.select(F.size("x")).first()
    width = width_row[0] if width_row else 1
    carried = [f for f in references.schema.fields if f.name != "x"]
    schema = T.StructType([queries.schema["qid"], *carried, T.StructField("distance", T.DoubleType())])
    names = [f.name for f in carried]
    n = bounded_count(references, broadcast_rows)
    if n <= broadcast_rows and fits_broadcast(n, width):
        rows = references.toPandas().sort_values("rid", kind="stable").reset_index(drop=True)
        sent = queries.sparkSession.sparkContext.broadcast((rows[names], matrix(rows["x"], width)))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            refs, points = sent.value
            for pdf in batches:
                if len(refs) and len(pdf):
                    yield from _top(pdf["qid"].to_numpy(), matrix(pdf["x"], width), refs, points, k, p, "qid")

        return queries.select("qid", "x").mapInPandas(search, schema)
    queries = queries.select("qid", "x")
    if bounded_count(queries, query_rows) <= query_rows and fits_broadcast(query_rows, width):
        return _few_queries(queries, references, k, p, width, schema, names)
    return _by_pivots(queries, references, k, p, width, schema, names, pivots, chunk_rows, distinct=distinct)


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "rid"))
    return found.withColumn("_rank", order).where(F.col("_rank") <= k).drop("_rank")


def _few_queries(queries, references, k, p, width, schema, names):
    """Each task keeps the k nearest of its own references per query; the best of those are kept."""
    rows = queries.toPandas()
    sent = queries.sparkSession.sparkContext.broadcast((rows["qid"].to_numpy(), matrix(rows["x"], width)))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, points = sent.value
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            refs = pdf.sort_values("rid", kind="stable").reset_index(drop=True)
            near = pd.concat(_top(ids, points, refs[names], matrix(refs["x"], width), k, p, "qid"))
            both = near if best is None else pd.concat([best, near])
            best = both.sort_values(["distance", "rid"], kind="stable").groupby("qid", sort=False).head(k)
        if best is not None:
            yield best

    return _nearest_of(references.select(*names, "x").mapInPandas(search, schema), k)


def _lowest(references: DataFrame, k: int) -> DataFrame:
    """Of equal points the k lowest ids, which alone can be neighbours; a point's copies are thinned out where they are read."""
    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            order = pdf["rid"].argsort(kind="stable")
            copy = pdf["x"].map(lambda v: np.asarray(v, float).tobytes()).iloc[order]
            yield pdf.iloc[order][(copy.groupby(copy.to_numpy(), sort=False).cumcount() < k).to_numpy()]

    thinned = references.mapInPandas(thin, references.schema)
    rank = F.row_number().over(Window.partitionBy("x").orderBy("rid"))
    return thinned.withColumn("_copy", rank).where(F.col("_copy") <= k).drop("_copy")


def meet_in_chunks(left: DataFrame, right: DataFrame, cells: dict[int, tuple[int, int]], chunk_rows: int, search, names: list[str], schema) -> DataFrame:
    """``search(queries, references)`` for the ``left(qid, x, _cell)`` and ``right(names, x, _cell)`` of every cell, in chunks of both.

    ``cells`` has how many of either a cell holds.
    """
    plan = [(i, max(1, math.ceil(n / chunk_rows)), max(1, math.ceil(m / chunk_rows))) for i, (n, m) in cells.items()]
    chunks = F.broadcast(left.sparkSession.createDataFrame(plan, "_cell long, _nq int, _nr int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    left = left.join(chunks, "_cell").select("qid", "x", "_cell", own("qid", "_nq").alias("_a"), each("_nr").alias("_b"))
    right = right.join(chunks, "_cell").select(*names, "x", "_cell", own("rid", "_nr").alias("_b"), each("_nq").alias("_a"))
    keys = ["_cell", "_a", "_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)


def reached_share(tree: PivotTree, x: np.ndarray, ball) -> float:
    """The share of all cells that a point of ``x`` has to visit on average."""
    if not len(x):
        return 0.0
    leaf, home = tree.assign(x)
    return (1 + len(tree.reached(x, np.broadcast_to(ball, len(x)), leaf, home)[0]) / len(x)) / len(tree.leaves)


def _by_pivots(queries, references, k, p, width, schema, names, pivots, chunk_rows, block_rows=BLOCK_ROWS, distinct=False):
    """Search every query's own cell first; its k-th distance there says which other cells it has to visit."""
    spark = queries.sparkSession
    refs = references if distinct else cut(_lowest(references, k), "references")
    n = refs.count()
    most = min(BROADCAST_ROWS, BROADCAST_CELLS // max(1, width))
    m = pivots or min(most, max(8, math.ceil(n / CELL_ROWS)))
    picked = refs.orderBy(F.xxhash64("rid")).limit(m).select("x").toPandas()
    tree = PivotTree(matrix(picked["x"], width), p)

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        r = r.sort_values("rid", kind="stable").reset_index(drop=True)
        return pd.concat(_top(q["qid"].to_numpy(), matrix(q["x"], width), r[names], matrix(r["x"], width), k, p, "qid"))

    plain = spark.sparkContext.broadcast(tree)
    place = [T.StructField("_cell", T.LongType()), T.StructField("_d", T.DoubleType())]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, d = plain.value.assign(matrix(pdf["x"], width))
            yield pdf.assign(_cell=cell, _d=d)

    stored = cut(refs.mapInPandas(assign, T.StructType([*refs.schema.fields, *place])), "stored")
    # One row per pivot reaches the driver.
    members = {r._cell: (r.far, r.n) for r in stored.groupBy("_cell").agg(F.max("_d").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    measured = spark.sparkContext.broadcast(tree.measured({i: far for i, (far, _) in members.items()}, {i: c for i, (_, c) in members.items()}))

    if width >= SCREENED_WIDTH and p == 2:
        asked = cut(queries.orderBy(F.xxhash64("qid")).limit(ASKED_ROWS), "asked")
        balls = _few_queries(asked, refs, k, p, width, schema, names).groupBy("qid").agg(F.max("distance").alias("ball"))
        some = asked.join(balls, "qid").toPandas()
        if reached_share(measured.value, matrix(some["x"], width), some["ball"].to_numpy(float)) > REACHED_SHARE:
            whole = lambda df: df.withColumn("_cell", F.lit(0).cast("long"))
            return _nearest_of(meet_in_chunks(whole(queries), whole(refs), {0: (queries.count(), n)}, block_rows, search, names, schema), k)
    placed = cut(queries.mapInPandas(assign, T.StructType([*queries.schema.fields, *place])), "placed")

    def met(left: DataFrame) -> DataFrame:
        loads = {r._cell: r["count"] for r in left.groupBy("_cell").count().collect()}
        return meet_in_chunks(left, stored, {i: (c, members.get(i, (0, 0))[1]) for i, c in loads.items() if i in members}, chunk_rows, search, names, schema)

    found = met(placed)
    whole_cells = max((count for _, count in members.values()), default=0) <= chunk_rows  # each query has met all of its cell at once
    at_home = cut(found if whole_cells else _nearest_of(found, k), "at_home")
    ball = at_home.groupBy("qid").agg(F.max("distance").alias("_ball"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == min(k, n)).drop("_n")
    asking = placed.join(ball, "qid", "left").select("qid", "x", "_cell", "_d", F.coalesce("_ball", F.lit(math.inf)).alias("_ball"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ball = matrix(pdf["x"], width), pdf["_ball"].to_numpy(float).copy()
            few = np.flatnonzero(np.isinf(ball))  # of which the own cell has less than k
            ball[few] = measured.value.bound(x[few], k)
            row, cell = measured.value.reached(x, ball, pdf["_cell"].to_numpy(), pdf["_d"].to_numpy())
            yield pdf.iloc[row][["qid", "x"]].reset_index(drop=True).assign(_cell=cell)

    routed = cut(asking.mapInPandas(route, T.StructType([queries.schema["qid"], queries.schema["x"], place[0]])), "routed")
    return _nearest_of(at_home.union(met(routed)), k)
