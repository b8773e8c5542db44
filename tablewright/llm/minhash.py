"""Near-duplicate documents: circulant MinHash bands, then exact Jaccard similarity.

Documents with equal shingle sets form a class at once. Class representatives that share a
band are candidates. Of these, a shingle that no other candidate holds can be in no
intersection, which bounds a document's similarity to any other and drops most that only
resemble each other. Then every band compares its members with its smallest one. Bands
whose members are one component are done. The members of the others are compared with all
that they are connected to through such bands, in blocks of bounded size, where they do not
belong to one component yet. Only links that join two components leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.llm import arrays as A
from tablewright.llm.sketches import COORDINATES, ROWS, SHINGLE, band_keys, set_hashes, shingle_sets, signatures
from tablewright.llm.tables import numbered, packed, settled, unpacked
from tablewright.llm.components import components

# Similarity of linked documents in percent.
PERCENT = 75
# Shingles of the documents that meet in one block; two such chunks are 32 MB.
CHUNK_SHINGLES = 2_000_000


def sketches(docs: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """(_n, n_shingles, s1, s2, keys): set size, two hashes of the set and its band keys."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, texts in A.text_blocks(frame["text"]):
                values, first = shingle_sets(texts, shingle)
                keys = A.signed(band_keys(signatures(values, first, coordinates), rows))
                s1, s2 = set_hashes(values, first)
                yield pd.DataFrame({"_n": frame["_n"].iloc[low: low + len(texts)].to_numpy(), "n_shingles": np.diff(first),
                                    "s1": A.signed(s1), "s2": A.signed(s2), "keys": list(keys)})

    return docs.select("_n", "text").mapInPandas(run, "_n long, n_shingles long, s1 long, s2 long, keys array<long>")


def shingle_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(_n, shingles): the sorted set of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, texts in A.text_blocks(frame["text"]):
                values, first = shingle_sets(texts, shingle)
                values = A.signed(values)
                yield pd.DataFrame({"_n": frame["_n"].iloc[low: low + len(texts)].to_numpy(),
                                    "shingles": [values[a:b] for a, b in zip(first[:-1], first[1:])]})

    return docs.select("_n", "text").mapInPandas(run, "_n long, shingles array<long>")


def _reaches(shared, a, b, percent: int):
    """Is ``shared`` of sets of sizes a and b enough? Whole numbers on both sides."""
    return shared * (100 + percent) >= (a + b) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("_n").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("_n").alias("b"), F.col("shingles").alias("y")), "b")
    return both.where(_reaches(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), percent)).select("a", "b")


def _crossing(percent: int):
    """Compare the documents of one block (or of two chunks) that belong to different components."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, labels = frame["_n"].to_numpy(), frame["label"].to_numpy()
        sizes, bound = frame["size"].to_numpy(), frame["bound"].to_numpy()
        sides = frame["chunk"].to_numpy()
        two = bool((frame["low"] != frame["high"]).any())
        lengths = np.array([len(s) for s in frame["shingles"]])
        owner = np.repeat(np.arange(len(ids)), lengths)
        values = np.concatenate(frame["shingles"].to_numpy())
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        above: dict[int, int] = {}

        def top(label: int) -> int:
            while (up := above.get(label, label)) != label:
                above[label] = label = above.get(up, up)
            return label

        # Every pair has an end outside the largest component.
        names, counts = np.unique(labels, return_counts=True)
        largest = names[counts.argmax()]
        links = []
        for i in np.flatnonzero(labels != largest):
            mine = np.asarray(frame["shingles"].iat[i])
            other = (labels != labels[i]) & _reaches(np.minimum(bound, bound[i]), sizes, sizes[i], percent)
            if two:
                other &= sides != sides[i]
            if not other.any():
                continue
            low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
            shared = np.bincount(owner[hits], minlength=len(ids))
            for j in np.flatnonzero(other & _reaches(shared, sizes, sizes[i], percent)):
                a, b = top(int(labels[i])), top(int(labels[j]))
                if a != b:
                    above[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def link_representatives(reps: DataFrame, docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """(a, b): links between different representatives that connect their components.

    ``reps`` has _n, n_shingles and keys; ``docs`` _n and text.
    """
    by_key = Window.partitionBy("key")
    spread = reps.select("_n", F.col("n_shingles").alias("size"), F.explode("keys").alias("key")).repartition("key")
    members = settled(spread.withColumn("c", F.count(F.lit(1)).over(by_key)).where("c > 1").drop("c"), "members")
    sets = settled(shingle_table(docs.join(members.select("_n").distinct(), "_n")), "sets")

    # A shingle of one candidate alone is in no intersection.
    alone = (sets.select("_n", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("_n").alias("_n"))
             .where("c = 1").groupBy("_n").agg(F.count(F.lit(1)).alias("alone")))
    bounded = members.join(alone, "_n", "left").withColumn("bound", F.col("size") - F.coalesce("alone", F.lit(0)))
    bounded = bounded.where(F.col("bound") * 100 >= F.col("size") * percent).select("key", "_n", "size", "bound")
    least = F.min(F.struct("_n", "size", "bound")).over(by_key)
    bands = settled(bounded.repartition("key").withColumn("pivot", least), "bands")

    stars = bands.where((F.col("_n") != F.col("pivot._n")) & _reaches(F.least(F.col("bound"), F.col("pivot.bound")), F.col("size"), F.col("pivot.size"), percent))
    first = settled(verified(stars.select(F.col("pivot._n").alias("a"), F.col("_n").alias("b")).distinct(), sets, percent), "links")
    label = components(first).select(F.col("node").alias("_n"), F.col("component").alias("label"))
    labelled = bands.join(label, "_n", "left").withColumn("label", F.coalesce("label", "_n")).repartition("key")
    open_ = settled(labelled.withColumn("l0", F.min("label").over(by_key)).withColumn("l1", F.max("label").over(by_key)).where("l0 <> l1")
                    .select("_n", "size", "bound", "label", F.col("pivot._n").alias("pivot")), "open")
    if open_.isEmpty():
        return first

    clouds = components(open_.select(F.col("pivot").alias("a"), F.col("_n").alias("b")).distinct())
    clouds = clouds.select(F.col("node").alias("_n"), F.col("component").alias("cloud"))
    each = settled(open_.drop("pivot").distinct().join(clouds, "_n"), "clouds")
    parts = each.groupBy("cloud").agg(F.ceil(F.sum("size") / chunk).cast("int").alias("parts"), F.count_distinct("label").alias("labels")).where("labels > 1")
    dealt = (each.join(parts.drop("labels"), "cloud").withColumn("chunk", F.pmod(F.xxhash64("_n"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cloud", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "_n", "size", "bound", "label"))
    more = (dealt.join(sets, "_n").groupBy("cloud", "low", "high").applyInPandas(_crossing(percent), "a long, b long"))
    return first.union(settled(more, "links"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(_n, doc_id, n_shingles, component_id, kept) per row of ``docs``.

    A document's set has its distinct runs of ``SHINGLE`` words, A-Z in lower case; with
    fewer words, the whole sequence. Documents whose sets have ``percent`` of their union in
    common are linked. component_id is the smallest doc_id reachable by links.

    * A null text, or one without words, has an empty set and is linked with nothing.
    * Copies have equal sets and are linked through one of them, however many there are.
    * Rows with equal doc_id are told apart by text (see ``tables.numbered``); rows without
      doc_id come first, and their component_id may be null. One row of a component is kept.
    * Further columns are not read. No rows: no result.
    * Links at the threshold are missed by all bands with a probability of 5e-6, and less
      above it; no candidate is dropped without an exact reason.
    """
    docs = numbered(docs.select("doc_id", "text"))
    sketched = sketches(docs)
    classes = settled(sketched.where("n_shingles > 0"), "sketches")
    same = classes.groupBy("s1", "s2").agg(F.min("_n").alias("rep"))
    classes = settled(classes.join(same, ["s1", "s2"]).select("_n", "n_shingles", "rep", F.when(F.col("_n") == F.col("rep"), F.col("keys")).alias("keys")), "classes")
    links = link_representatives(classes.where("keys is not null"), docs, percent)
    component = components(links).select(F.col("node").alias("rep"), "component")
    placed = classes.join(component, "rep", "left").select("_n", "n_shingles", F.coalesce("component", "rep").alias("component"))
    names = docs.select(F.col("_n").alias("component"), F.col("doc_id").alias("component_id"))
    placed = docs.select("_n", "doc_id").join(placed, "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    return placed.join(names, "component").select(
        "_n", "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_id", (F.col("component") == F.col("_n")).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    rows = numbered(packed(docs, "doc_id", "text"))
    kept = near_duplicates(docs, percent).where("kept").select("_n")
    return unpacked(rows.join(kept, "_n", "left_semi"), docs.columns, "doc_id", "text")
