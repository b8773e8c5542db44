"""Connected components by alternating large-star and small-star (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.lookup import spread_lookup
from tablewright.runtime import BROADCAST_ROWS, cut

# With more edges than this the hubs of large components are joined apart.
HUB_EDGES = 1_000_000


def connected_components(edges: DataFrame, most_rounds: int = 100, hub_edges: int = HUB_EDGES,
                         small: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) of ``edges(a, b)``; a component is named by its smallest node.

    Every round is two grouped minima joined back to the edges; the number of
    rounds grows with the logarithm of the graph, not with its diameter. Lineage
    is cut each round. The loop ends when every node hangs on one centre. A graph
    of at most ``small`` edges is settled at once.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = links.count()
    if n <= small:
        pairs = sorted(_settle(links.collect()).items())
        return edges.sparkSession.createDataFrame(pairs, "node long, component long")
    for _ in range(most_rounds):
        if n == 0 or _is_star_forest(links):
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, "b > a", n, hub_edges).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        hung = _to_smallest(large, None, n, hub_edges)
        links = cut(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
                    .where("a <> b").distinct(), "links")
        n = links.count()
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _settle(links: list) -> dict[int, int]:
    """Smallest node of the component of every node of a few links."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        above.setdefault(node, node)
        while above[node] != node:
            above[node] = node = above[above[node]]
        return node

    for a, b in links:
        first, second = sorted((top(a), top(b)))
        above[second] = first
    return {node: top(node) for node in list(above)}


def _is_star_forest(links: DataFrame) -> bool:
    """Has every outer node one link, and is no centre an outer node?"""
    repeated = links.groupBy("a").count().where("count > 1").select("a")
    chained = links.select(F.col("b").alias("a")).join(links.select("a").distinct(), "a", "left_semi")
    return repeated.union(chained).isEmpty()


def _to_smallest(links: DataFrame, kept: str | None, n: int, hub_edges: int) -> DataFrame:
    """(a, b, m): every kept link with the smallest of ``a`` and all its neighbours."""
    low = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = links.where(kept) if kept else links
    if n <= hub_edges:
        return rows.join(low.select("a", "m"), "a")
    return spread_lookup(rows, low, "a", "a", "m", 2 * n)
