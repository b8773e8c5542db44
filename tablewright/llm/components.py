"""Connected components of a graph of links: one task for a small graph, rounds of joins for a large one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tablewright.llm.tables import settled
from tablewright.operators.components import connected_components
from tablewright.runtime import bounded_count

# Links that one task settles; with two longs each they take a few megabytes.
ONE_TASK = 200_000


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``; a component is named by its smallest node.

    The size is checked first. Larger graphs go through alternating star joins, with the
    same result.
    """
    rows = settled(links.where("a <> b").distinct(), "graph")
    if bounded_count(rows, one_task) > one_task:
        return connected_components(rows, small=0)
    return rows.coalesce(1).mapInPandas(_settle, "node long, component long")


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    above: dict[int, int] = {}

    def top(node: int) -> int:
        above.setdefault(node, node)
        while above[node] != node:
            above[node] = node = above[above[node]]
        return node

    for frame in frames:
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            a, b = sorted((top(a), top(b)))
            above[b] = a
    nodes = list(above)
    yield pd.DataFrame({"node": nodes, "component": [top(n) for n in nodes]}, dtype="int64")
