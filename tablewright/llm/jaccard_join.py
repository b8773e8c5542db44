"""N-gram Jaccard join with an R-tree over count vectors.

Documents with equal sets form a class at once. The join of the classes is split without
loss: linked sets differ in a bounded number d of shingles, so of more than d groups of
shingles (by hash; their number depends on the set's size) one is the same in both, and
classes meet by the content of a group. A passage that many documents share fills no whole
group of theirs, so it makes no large block. Every block first compares its members with
its smallest one. Blocks that are then one component are done. Members of the others, and
all that they are connected to through such blocks, are dealt into chunks of bounded size;
every two chunks are joined by an R-tree over the counts of shingles per group: a sum of
smaller counts bounds the overlap with a node or a member, nodes of the point's own
component are passed by, and what survives is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm import arrays as A
from tablewright.llm.components import components
from tablewright.llm.count_tree import GROUPS, CountTree, count_vectors, reaches
from tablewright.llm.sketches import set_hashes, shingle_sets
from tablewright.llm.tables import numbered, settled
from tablewright.runtime import BROADCAST_ROWS, bounded_count

SHINGLE = 3
PERCENT = 90
# Sizes that share a level differ by this factor at most.
LEVEL = 1.4
# Shingles (and a share for the count vector) of the classes of one chunk; two chunks are some 20 MB.
CHUNK = 1_000_000
# Points that ask an R-tree at once, between updates of the components.
ASKING = 512
_KEY, _CONTENT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@lru_cache(maxsize=4096)
def _top(level: int, percent: int) -> int:
    """Largest size of a level."""
    low = 1 if level == 0 else _top(level - 1, percent) + 1
    return max(low, int(low * max(LEVEL, 100 / percent)))


def _levels(sizes: np.ndarray, percent: int) -> np.ndarray:
    tops = []
    while not tops or tops[-1] < sizes.max(initial=0):
        tops.append(_top(len(tops), percent))
    return np.searchsorted(tops, sizes, "left")


def _groups(level: int, percent: int) -> tuple[int, int]:
    """(groups, of these the same in any two linked sets) of a level.

    Linked sets of sizes a and b differ in at most (a + b) (100 - percent) / (100 + percent)
    shingles. A few groups more than that keep empty groups from being all that agrees.
    """
    most = 2 * _top(level, percent) * (100 - percent) // (100 + percent)
    same = 2 + most // 32
    return most + same, same


def group_keys(values: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): hashes of level, group and content; linked sets have a key in common.

    A set takes part in its own level and, if a linked set can be larger than that, in the
    next one. Keys of empty groups are only made by sets that have so many of them that
    nothing else might agree.
    """
    sizes = np.diff(first)
    level = _levels(sizes, percent)
    mixed = A.mix64(values ^ _KEY)
    place = mixed >> np.uint64(32)
    content = A.mix64(values ^ _CONTENT)
    upper, lower = (content >> np.uint64(32)).astype(float), (content & np.uint64(0xFFFFFFFF)).astype(float)
    tops = np.array([_top(k, percent) for k in range(int(level.max(initial=0)) + 1)])
    beyond = sizes * 100 // percent > tops[level]
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in range(int(level.max(initial=0)) + 2):
        some = np.flatnonzero(((level == k) | ((level == k - 1) & beyond)) & (sizes > 0))
        if not len(some):
            continue
        m, same = _groups(k, percent)
        n = sizes[some]
        at = np.arange(n.sum()) + np.repeat(first[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        cell = np.repeat(np.arange(len(some)) * m, n) + ((place[at] * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        count = np.bincount(cell, minlength=len(some) * m)
        # Sums of 32-bit halves are exact in doubles.
        key = np.bincount(cell, lower[at], minlength=len(some) * m).astype(np.uint64)
        key = A.mix64(key + _KEY) + np.bincount(cell, upper[at], minlength=len(some) * m).astype(np.uint64)
        group = np.tile(np.arange(m, dtype=np.uint64), len(some))
        key = A.mix64(A.mix64(key) + A.mix64(group * np.uint64(4099) + np.uint64(k + 1)) + count.astype(np.uint64))
        empty = (count == 0).reshape(len(some), m)
        used = ~empty | (empty.sum(axis=1) >= same)[:, None]
        owners.append(np.repeat(some, m)[used.ravel()])
        keys.append(key[used.ravel()])
    return np.concatenate(owners), np.concatenate(keys)


def sketches(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(_n, n_shingles, s1, s2, keys): set size, two hashes of the set and the keys of its groups."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, texts in A.text_blocks(frame["text"]):
                values, first = shingle_sets(texts, shingle)
                owner, keys = group_keys(values, first, percent)
                order = np.argsort(owner, kind="stable")
                keys = np.split(A.signed(keys[order]), np.searchsorted(owner[order], np.arange(1, len(texts))))
                s1, s2 = set_hashes(values, first)
                yield pd.DataFrame({"_n": frame["_n"].iloc[low: low + len(texts)].to_numpy(), "n_shingles": np.diff(first),
                                    "s1": A.signed(s1), "s2": A.signed(s2), "keys": keys})

    return docs.select("_n", "text").mapInPandas(run, "_n long, n_shingles long, s1 long, s2 long, keys array<long>")


def set_table(docs: DataFrame, shingle: int) -> DataFrame:
    """(_n, shingles, point): the sorted set of every document and its counts per group as bytes."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, texts in A.text_blocks(frame["text"]):
                values, first = shingle_sets(texts, shingle)
                points = count_vectors(values, first)
                values = A.signed(values)
                yield pd.DataFrame({"_n": frame["_n"].iloc[low: low + len(texts)].to_numpy(),
                                    "shingles": [values[a:b] for a, b in zip(first[:-1], first[1:])], "point": [p.tobytes() for p in points]})

    return docs.select("_n", "text").mapInPandas(run, "_n long, shingles array<long>, point binary")


def _points(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), GROUPS)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sums of smaller counts are large enough."""
    points = sets.select("_n", "point")
    both = pairs.join(points.withColumnsRenamed({"_n": "a", "point": "x"}), "a").join(points.withColumnsRenamed({"_n": "b", "point": "y"}), "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y = _points(frame["x"]), _points(frame["y"])
            keep = reaches(np.minimum(x, y).sum(axis=1, dtype=np.int64), x.sum(axis=1, dtype=np.int64), y.sum(axis=1, dtype=np.int64), percent)
            yield frame.loc[keep, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    full = sets.select("_n", "shingles")
    both = pairs.join(full.withColumnsRenamed({"_n": "a", "shingles": "x"}), "a").join(full.withColumnsRenamed({"_n": "b", "shingles": "y"}), "b")
    return both.where(reaches(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent)).select("a", "b")


def _crossing(percent: int):
    """Links between components among the classes of one chunk, or between two chunks, by an R-tree."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, sides = frame["_n"].to_numpy(), frame["chunk"].to_numpy()
        points, sets = _points(frame["point"]), frame["shingles"].to_numpy()
        names, label = np.unique(frame["label"].to_numpy(), return_inverse=True)
        two = bool((frame["low"] != frame["high"]).any())
        held = np.flatnonzero(sides == frame["high"].iloc[0])
        asking = np.flatnonzero(sides == frame["low"].iloc[0])
        if two and len(asking) > len(held):
            held, asking = asking, held
        tree = CountTree(points[held], percent)
        above = np.arange(len(names))
        links = []

        def top(i: int) -> int:
            while above[i] != i:
                above[i] = i = above[above[i]]
            return int(i)

        for at in range(0, len(asking), ASKING):
            part = asking[at: at + ASKING]
            tops = np.array([top(i) for i in range(len(names))])
            current = tops[label]
            query, member = tree.candidates(points[part], current[part], current[held])
            for i, j in zip(part[query].tolist(), held[member].tolist()):
                a, b = top(label[i]), top(label[j])
                if a == b or (not two and j < i):
                    continue  # connected by now, or compared when j asked
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if reaches(shared, len(sets[i]), len(sets[j]), percent):
                    above[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` with one of ``ids``, which are sent to every executor if they are few."""
    return docs.join(F.broadcast(ids) if bounded_count(ids, BROADCAST_ROWS) <= BROADCAST_ROWS else ids, "_n", "left_semi")


def link_classes(reps: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between different classes that connect their components.

    ``reps`` has _n, n_shingles and keys; ``docs`` _n and text.
    """
    spread = reps.select("_n", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    shared = settled(spread.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    members = settled(spread.join(shared, "key"), "members")
    sets = settled(set_table(_of(docs, settled(members.select("_n").distinct(), "ids")), shingle), "sets")

    pivots = members.groupBy("key").agg(F.min(F.struct("_n", "size")).alias("pivot"))
    starred = members.join(pivots, "key").where(F.col("_n") != F.col("pivot._n"))
    near = (F.least("size", "pivot.size") * 100 >= F.greatest("size", "pivot.size") * percent)
    stars = starred.where(near).select(F.col("pivot._n").alias("a"), F.col("_n").alias("b")).distinct()
    first = settled(verified(settled(bounded(stars, sets, percent), "stars"), sets, percent), "links")

    label = components(first).select(F.col("node").alias("_n"), F.col("component").alias("label"))
    # Two members have been compared; of three or more, those that are not the smallest have not.
    labelled = settled(members.where("c > 2").join(label, "_n", "left").withColumn("label", F.coalesce("label", "_n")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("_n").alias("pivot")).where("l0 <> l1")
    open_ = settled(labelled.join(mixed.select("key", "pivot"), "key").select("_n", "size", "label", "pivot").distinct(), "open")
    if open_.isEmpty():
        return first

    clouds = components(open_.select(F.col("pivot").alias("a"), F.col("_n").alias("b")))
    clouds = clouds.select(F.col("node").alias("_n"), F.col("component").alias("cloud"))
    each = settled(open_.drop("pivot").distinct().join(clouds, "_n"), "clouds")
    parts = each.groupBy("cloud").agg(F.ceil(F.sum(F.col("size") + GROUPS) / chunk).cast("int").alias("parts"),
                                      F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
    dealt = (each.join(parts.select("cloud", "parts"), "cloud").withColumn("chunk", F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cloud", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "_n", "label"))
    more = dealt.join(sets, "_n").groupBy("cloud", "low", "high").applyInPandas(_crossing(percent), "a long, b long")
    return first.union(settled(more, "links"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    A document's set has its distinct runs of ``shingle`` words, A-Z in lower case; with
    fewer words, the whole sequence. Documents whose sets have ``percent`` of their union in
    common are linked; component_id is the smallest doc_id reachable by links. No link
    between different sets is missed (sets are compared by 64-bit hashes of their shingles).

    * A null text, or one without words, has an empty set and is linked with nothing.
    * Copies have equal sets and are linked through one of them, however many there are.
    * Rows with equal doc_id are told apart by text (see ``tables.numbered``); rows without
      doc_id come first, and their component_id may be null.
    * Further columns are not read, whatever their names. No rows: no result.
    * Texts of any length are read whole; a text takes some 30 times its bytes while its set is made.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent has to be above 0 and at most 100")
    docs = numbered(docs.select("doc_id", "text"))
    sketched = settled(sketches(docs, shingle, percent).where("n_shingles > 0"), "sketches")
    same = sketched.groupBy("s1", "s2").agg(F.min("_n").alias("rep"))
    classes = settled(sketched.drop("keys").join(same, ["s1", "s2"]).select("_n", "n_shingles", "rep"), "classes")
    reps = sketched.select("_n", "n_shingles", "keys").join(classes.where("_n = rep").select("_n"), "_n", "left_semi")
    links = link_classes(reps, docs, shingle, percent, chunk)
    component = components(links).select(F.col("node").alias("rep"), "component")
    placed = classes.join(component, "rep", "left").select("_n", "n_shingles", F.coalesce("component", "rep").alias("component"))
    names = docs.select(F.col("_n").alias("component"), F.col("doc_id").alias("component_id"))
    placed = docs.select("_n", "doc_id").join(placed, "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    return placed.join(names, "component").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id")
