"""DBSCAN on points of many columns, by cells of pivots.

A grid of cells with a diameter of eps holds single points there. Instead every point goes
to the cell of its nearest pivot, and asks those cells too that its ball of radius eps can
reach. Cells meet in chunks, so no task holds a crowded one, and a chunk pair answers with
sums, smallest labels or a spanning forest of its links, never with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions.blocks import SCREENED_WIDTH, distances, matrix, row_slices, screen
from tablewright.operators.components import connected_components
from tablewright.operators.lookup import lookup
from tablewright.operators.neighbours import ASKED_ROWS, BLOCK_ROWS, CELL_ROWS, CHUNK_ROWS, REACHED_SHARE, meet_in_chunks, reached_share
from tablewright.operators.ordering import with_position
from tablewright.operators.pivots import PivotTree
from tablewright.runtime import BROADCAST_CELLS, BROADCAST_ROWS, cut


def _forest(q: np.ndarray, r: np.ndarray, near: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the links (row of q, row of r) those that join two parts, as ids."""
    names, place = np.unique(np.concatenate([q, r]), return_inverse=True)
    left, right = place[: len(q)], place[len(q):]
    above = list(range(len(names)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    links = []
    for i, j in near:
        i, j = left[i], right[j]
        if len(i) > len(names):  # fewer points than links: those already joined are left out at once
            label = np.array([top(k) for k in range(len(names))])
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = top(a), top(b)
            if x != y:
                above[max(x, y)] = min(x, y)
                links.append((names[a], names[b]))
    return links


class _Cells:
    """Points in the cells of pivots, and what every point asks."""

    def __init__(self, points: DataFrame, eps: float, p: float, pivots: int | None, chunk_rows: int, block_rows: int = BLOCK_ROWS):
        self.eps, self.p, self.chunk_rows = eps, p, chunk_rows
        self.width = width = len(points.first().x)
        n = points.count()
        most = min(BROADCAST_ROWS, BROADCAST_CELLS // max(1, width))
        picked = points.orderBy(F.xxhash64("pid")).limit(pivots or min(most, max(8, math.ceil(n / CELL_ROWS)))).select("x").toPandas()
        tree = PivotTree(matrix(picked["x"], width), p)
        context = points.sparkSession.sparkContext
        plain = context.broadcast(tree)
        place = [T.StructField("_cell", T.LongType()), T.StructField("_d", T.DoubleType())]

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                cell, d = plain.value.assign(matrix(pdf["x"], width))
                yield pdf.assign(_cell=cell, _d=d)

        self.stored = cut(points.mapInPandas(assign, T.StructType([*points.schema.fields, *place])), "stored")
        far = {r._cell: r.far for r in self.stored.groupBy("_cell").agg(F.max("_d").alias("far")).collect()}  # one row per pivot
        measured = context.broadcast(tree.measured(far))
        if width >= SCREENED_WIDTH and p == 2:
            some = points.orderBy(F.xxhash64("pid")).limit(ASKED_ROWS).select("x").toPandas()
            if reached_share(tree, matrix(some["x"], width), eps) > REACHED_SHARE:
                # cells rule out too little: large blocks of all points meet
                self.chunk_rows = block_rows
                self.stored = cut(points.withColumn("_cell", F.lit(0).cast("long")), "stored")
                self.asking = cut(self.stored.select(F.col("pid").alias("qid"), "x", "_cell"), "asking")
                return

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                own, home = pdf["_cell"].to_numpy(), pdf["_d"].to_numpy()
                row, cell = measured.value.reached(matrix(pdf["x"], width), np.full(len(pdf), eps), own, home)
                yield pd.concat([pdf[["qid", "x", "_cell"]], pdf.iloc[row][["qid", "x"]].assign(_cell=cell)])

        asking = self.stored.select(F.col("pid").alias("qid"), "x", "_cell", "_d")
        self.asking = cut(asking.mapInPandas(route, "qid long, x array<double>, _cell long"), "asking")

    def answered(self, asking: DataFrame, members: DataFrame, names: list[str], answer, schema: str) -> DataFrame:
        """What ``answer(queries, members, near)`` says for every pair of chunks; ``near`` yields rows of both within eps."""
        width, eps, p = self.width, self.eps, self.p
        count = lambda df: {r._cell: r["count"] for r in df.groupBy("_cell").count().collect()}
        asked, held = count(asking), count(members)
        empty = pd.DataFrame({c.split(" ")[0]: [] for c in schema.split(", ")})

        def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return empty
            x, y = matrix(q["x"], width), matrix(r["x"], width)

            fast = screen(y, p)
            fast = fast if fast and fast.safe(x) else None

            def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for part in row_slices(len(x), len(y)):
                    i, j = fast.within(x[part], eps) if fast else np.nonzero(distances(x[part], y, p) <= eps)
                    yield i + (part.start or 0), j

            return answer(q, r, near())

        cells = {i: (n, held[i]) for i, n in asked.items() if i in held}
        if not cells:
            return asking.sparkSession.createDataFrame([], schema)
        return meet_in_chunks(asking, members, cells, self.chunk_rows, search, ["rid", *names], schema)


def label_points(points: DataFrame, eps: float, min_samples: int, p: float = 2.0, pivots: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(pid, cluster, core) of distinct ``points(pid, x, w)``; noise is -1, clusters follow their smallest core pid."""
    cells = _Cells(points, eps, p, pivots, chunk_rows)
    members = cells.stored.withColumnRenamed("pid", "rid")

    def weigh(q: pd.DataFrame, r: pd.DataFrame, near) -> pd.DataFrame:
        total, w = np.zeros(len(q), np.int64), r["w"].to_numpy()
        for i, j in near:
            np.add.at(total, i, w[j])
        return pd.DataFrame({"pid": q["qid"].to_numpy(), "n": total})

    weights = cells.answered(cells.asking, members, ["w"], weigh, "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n"))
    core = cut(weights.select("pid", (F.col("n") >= min_samples).alias("core")), "core")
    cores = core.where("core").select("pid")
    inner = cut(members.join(cores.withColumnRenamed("pid", "rid"), "rid", "left_semi"), "cores")

    def join(q: pd.DataFrame, r: pd.DataFrame, near) -> pd.DataFrame:
        return pd.DataFrame(_forest(q["qid"].to_numpy(), r["rid"].to_numpy(), near), columns=["a", "b"], dtype="int64")

    between = cells.asking.join(cores.withColumnRenamed("pid", "qid"), "qid", "left_semi")
    links = cells.answered(between, inner, [], join, "a long, b long")
    component = connected_components(links).withColumnRenamed("node", "pid")
    labelled = cut(cores.join(component, "pid", "left").select("pid", F.coalesce("component", "pid").alias("component")), "labelled")
    sizes = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    numbers = cut(with_position(sizes, ["component"], "cluster"), "numbers")
    numbered = cut(lookup(labelled, numbers, "component", "component", "cluster").select("pid", F.col("cluster").cast("long").alias("cluster")), "numbered")

    def smallest(q: pd.DataFrame, r: pd.DataFrame, near) -> pd.DataFrame:
        best, label = np.full(len(q), np.iinfo(np.int64).max), r["cluster"].to_numpy()
        for i, j in near:
            np.minimum.at(best, i, label[j])
        reached = best < np.iinfo(np.int64).max
        return pd.DataFrame({"pid": q["qid"].to_numpy()[reached], "cluster": best[reached]})

    loose = cells.asking.join(core.where("not core").select(F.col("pid").alias("qid")), "qid", "left_semi")
    near_cores = inner.join(numbered.withColumnRenamed("pid", "rid"), "rid")
    border = cells.answered(loose, near_cores, ["cluster"], smallest, "pid long, cluster long").groupBy("pid").agg(F.min("cluster").alias("cluster"))
    return core.join(numbered.union(border), "pid", "left").select("pid", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "core")
