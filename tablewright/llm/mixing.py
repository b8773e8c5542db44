"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of words in a pseudo-random order. A source's target says
how many passes over that order are taken and how far the last one goes, which gives exact
block quotas. A binary tree splits the quotas among the output shards: at each node the
left half gets a multivariate-hypergeometric draw, so every shard is a random sample
without replacement of the whole mix. A shard then takes its disjoint range of each
source's order and shuffles what it took.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.tables import packed, unpacked
from tablewright.runtime import cut, new_folder

# The weights of sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 256
SHARDS = 64
# Blocks of a source ranked by one window, and most such windows for a source.
RANKED_TOGETHER = 2_000
MOST_RANGES = 1 << 16
# Blocks, and whole documents, of a shard in one task, about.
SHARD_ROWS = 100_000
SHARD_DOCUMENTS = 5_000
# Populations that numpy draws from.
_NUMPY_ITEMS = 1_000_000_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class SourcePlan:
    source: str | None
    size: int
    target: float


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> list[SourcePlan]:
    """Targets of the sources in code point order, null last.

    Together they are ``share`` times all sizes, dealt by weight; a source stops at ``most``
    times its size and what it leaves is dealt again among the others.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[n] for n in names if n in open_)
        full = [n for n in names if n in open_ and left * weight[n] / total > most * sizes[n]]
        if not full:
            target.update({n: left * weight[n] / total for n in open_})
            break
        for n in full:
            target[n] = float(most * sizes[n])
            open_.discard(n)
        left = share * sum(sizes.values()) - sum(target[n] for n in names if n in target)
    return [SourcePlan(n, sizes[n], target[n]) for n in names]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items are good; beyond numpy's range by inversion of the same law."""
    if drawn == 0 or good == 0:
        return 0
    if bad == 0:
        return drawn
    if good + bad < _NUMPY_ITEMS:
        return int(rng.hypergeometric(good, bad, drawn))
    return _inverted(rng.random(), good, bad, drawn)


def _inverted(u: float, good: int, bad: int, drawn: int) -> int:
    """The hypergeometric count with cumulated probability ``u``.

    Neighbouring probabilities have a rational ratio, so all of them follow from that of the
    mode. Counts more than 12 standard deviations from the mean have less than 1e-30 of the
    probability together, which a double cannot tell from nothing.
    """
    total = good + bad
    mean = drawn * good / total
    spread = (mean * (bad / total) * ((total - drawn) / (total - 1))) ** 0.5
    low, high = max(0, drawn - bad, int(mean - 12 * spread) - 12), min(good, drawn, int(mean + 12 * spread) + 12)
    k = np.arange(low, high, dtype=float)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (float(bad - drawn) + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(share, u * share[-1], "right"))


def split_quotas(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """(sources, shards) block counts: rows sum to the quotas, shards differ by one block at most."""
    out = np.zeros((len(quotas), shards), np.int64)
    total = sum(quotas)
    ends = [total * (j + 1) // shards for j in range(shards)]
    stack = [(0, shards, list(quotas))]
    while stack:
        low, high, here = stack.pop()
        if high - low == 1:
            out[:, low] = here
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        wanted = ends[middle - 1] - (ends[low - 1] if low else 0)
        rest, left = sum(here), []
        for quota in here:
            rest -= quota
            left.append(_hypergeometric(rng, quota, rest, wanted))
            wanted -= left[-1]
        stack += [(low, middle, left), (middle, high, [q - n for q, n in zip(here, left)])]
    return out


def row_keys() -> list[Column]:
    """Two hashes that tell rows of documents apart; equal only for equal rows."""
    parts = [F.col("doc_id"), F.col("source"), F.col("text")]
    return [F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(17), *reversed(parts)).alias("_k2")]


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, _k1, _k2, _copy): one narrow row per document.

    Equal rows are counted, which combines before the shuffle, and numbered from 1 after it.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row_keys())
    equal = rows.groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in ("doc_id", "source", "size")], F.count(F.lit(1)).alias("n"))
    return equal.select("doc_id", "source", "size", "_k1", "_k2", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy"))


def draw(rows: DataFrame, block_words: int | None = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, list[SourcePlan]]:
    """Blocks that the mix takes, and the plan of each source.

    ``rows`` is a written table of ``sized_rows``. The result has a row per taken block:
    (_k1, _k2, _copy, doc_id, source, first_word, words, pass, shard, _order); a shard is
    read in ``_order``. The last block of a source may be cut short, so the taken words
    are its target, rounded. With ``block_words=None`` documents are taken whole.
    Collected are one row per source and one per source and rank range.
    """
    spark = rows.sparkSession
    plans = targets({r["source"]: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()})
    if block_words is None:
        blocks = rows.where("size > 0").withColumn("_block", F.lit(0).cast("long")).withColumn("words", F.col("size"))
    else:
        last = F.floor((F.col("size") - 1) / block_words)
        blocks = (rows.where("size > 0").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
                  .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("_block") * block_words)))
    blocks = blocks.withColumn("_hash", F.xxhash64(F.lit(seed), "_k1", "_k2", "_copy", "_block"))
    most = blocks.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    bits = min(int(max(1, most // RANKED_TOGETHER)).bit_length(), MOST_RANGES.bit_length() - 1)
    blocks = blocks.withColumn("_range", F.shiftrightunsigned("_hash", 64 - bits))

    ranges = blocks.groupBy("source", "_range").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words")).collect()
    sums: dict[str | None, list[int]] = {}
    before = []
    for r in sorted(ranges, key=lambda r: (r["source"] is None, r["source"] or "", r["_range"])):
        seen = sums.setdefault(r["source"], [0, 0])
        before.append((r["source"], r["_range"], *seen))
        seen[0] += r["n"]
        seen[1] += r["words"]
    # Whole passes, and the words of the pass that is cut.
    passes = {p.source: divmod(round(p.target), p.size) if p.size else (0, 0) for p in plans}
    offsets = spark.createDataFrame(
        [(s, k, n, w, int(passes[s][0]), int(passes[s][1]), sums[s][0]) for s, k, n, w in before],
        "source string, _range long, _n0 long, _w0 long, _whole int, _part long, _n long")
    inside = Window.partitionBy("source", "_range").orderBy("_hash", "_k1", "_k2", "_copy", "_block")
    same = F.col("b.source").eqNullSafe(F.col("o.source")) & (F.col("b._range") == F.col("o._range"))
    ranked = (blocks.withColumn("_rank", F.row_number().over(inside) - 1)
              .withColumn("_ahead", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("b")
              .join(F.broadcast(offsets).alias("o"), same)
              .select("b.*", (F.col("_rank") + F.col("_n0")).alias("_place"), (F.col("_ahead") + F.col("_w0")).alias("_before"), "_whole", "_part", "_n")
              .drop("_rank", "_ahead", "_range"))
    ranked = cut(ranked.withColumn("_cut", F.when(F.col("_before") < F.col("_part"), F.least(F.col("words"), F.col("_part") - F.col("_before"))).otherwise(F.lit(0))
                                   if block_words else
                                   F.when(F.col("_before") + F.col("words") / 2 <= F.col("_part"), F.col("words")).otherwise(F.lit(0))), "ranked")

    partial = {r["source"]: r["n"] for r in ranked.where("_cut > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = [sums.get(p.source, (0, 0))[0] * int(passes[p.source][0]) + partial.get(p.source, 0) for p in plans]
    shares = split_quotas(quotas, shards, seed)
    ends = spark.createDataFrame([(p.source, [int(e) for e in np.cumsum(row)]) for p, row in zip(plans, shares)], "source string, _ends array<long>")
    taken = (ranked.withColumn("_pass", F.explode(F.expr("sequence(0, _whole)"))).withColumnRenamed("_cut", "_c")
             .withColumn("_took", F.when(F.col("_pass") < F.col("_whole"), F.col("words")).otherwise(F.col("_c"))).where("_took > 0").alias("t"))
    place = F.col("_place") + F.col("_pass") * F.col("_n")
    taken = (taken.join(F.broadcast(ends).alias("e"), F.col("t.source").eqNullSafe(F.col("e.source"))).drop(F.col("e.source"))
             .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= place))))
    return taken.select("_k1", "_k2", "_copy", "doc_id", F.col("t.source").alias("source"), (F.col("_block") * (block_words or 0)).alias("first_word"),
                        F.col("_took").cast("long").alias("words"), F.col("_pass").alias("pass"), "shard",
                        F.xxhash64(F.lit(seed + 1), "_k1", "_k2", "_copy", "_block", "_pass").alias("_order")), plans


def _part_bits(taken: DataFrame, shards: int, rows: int) -> int:
    """Bits of ``_order`` that name a part, so that a part has at most about ``rows`` rows."""
    return int(taken.count() // (shards * rows)).bit_length()


def _part(bits: int) -> Column:
    return F.shiftrightunsigned("_order", 64 - bits).cast("int") if bits else F.lit(0)


def write_shards(taken: DataFrame, shards: int = SHARDS, rows: int = SHARD_ROWS) -> DataFrame:
    """The mix as written shards, read back: (the columns of ``draw``, part).

    A shard is a folder. It is shuffled by ``_order``, a hash; ranges of that are its parts,
    so that a large shard is written by many tasks, and its parts in order and their rows in
    order are the shard.
    """
    spark = taken.sparkSession
    taken = cut(taken, "taken")
    bits = _part_bits(taken, shards, rows)
    dealt = taken.withColumn("part", _part(bits)).repartition(shards << bits, "shard", "part")
    path = new_folder(spark, "shards")
    dealt.sortWithinPartitions("shard", "part", "_order", "_k1", "_k2", "_copy", "first_word").write.partitionBy("shard").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def mix_report(docs: DataFrame, block_words: int | None = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces, shards) per row of ``docs``.

    The drawn blocks are written as shards; taken, pieces and shards are the words, the
    blocks and the shards that were read from there.

    * A null text has size 0 and is never taken; a null source is a source of its own, last.
    * Equal rows are separate documents; null doc_ids are allowed. No rows: no result.
    * A source of size 0 has target 0. No document is taken more than ``MOST_PASSES`` times.
    * The order depends on hashes of the rows alone, so reruns agree on any partitioning.
    * Columns other than doc_id, source and text are not read.
    """
    rows = cut(sized_rows(docs), "sizes")
    taken, plans = draw(rows, block_words, shards, seed)
    per_shard = write_shards(taken, shards).groupBy("_k1", "_k2", "_copy", "shard").agg(F.sum("words").alias("taken"), F.count(F.lit(1)).alias("pieces"))
    per_row = per_shard.groupBy("_k1", "_k2", "_copy").agg(F.sum("taken").alias("taken"), F.sum("pieces").alias("pieces"), F.count(F.lit(1)).alias("shards"))
    plan = docs.sparkSession.createDataFrame([(p.source, p.size, p.target) for p in plans], "source string, source_size long, target double")
    return (rows.join(per_row, ["_k1", "_k2", "_copy"], "left").alias("r")
            .join(F.broadcast(plan).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .select("doc_id", "size", "source_size", "target", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "pieces", "shards")]))


def mix_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix as documents: whole rows of ``docs``, each as often as it was taken, by shard and shuffled within it.

    Documents are drawn whole, so a source's words miss its target by half a document at
    most. Documents without words, null texts among them, are not taken. Repeated rows are
    documents of their own; a null source is a source, the last one. All columns are kept,
    whatever their names. No rows: no result.
    """
    sized = cut(sized_rows(docs), "sizes")
    taken = cut(draw(sized, None, shards, seed)[0], "taken")
    bits = _part_bits(taken, shards, SHARD_DOCUMENTS)
    counts = taken.select("_k1", "_k2", "_copy", "shard", _part(bits).alias("part"), "_order")
    rows = packed(docs, "doc_id", "source", "text").select("*", *row_keys())
    # Only where rows repeat do their texts have to meet before the join.
    repeated = not sized.where("_copy > 1").isEmpty()
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("doc_id")) if repeated else F.lit(1))
    mixed = rows.join(counts, ["_k1", "_k2", "_copy"]).repartition(shards << bits, "shard", "part").sortWithinPartitions("shard", "part", "_order")
    return unpacked(mixed, docs.columns, "doc_id", "source", "text")
