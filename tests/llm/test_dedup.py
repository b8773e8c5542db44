"""Substring and near-duplicate removal against plain versions."""

import brute
import numpy as np
import pytest

from tablewright.llm import arrays, minhash, sketches, substring_dedup


@pytest.mark.parametrize("length, start", [(20, 10), (13, 2), (8, 3)])
def test_substrings(spark, length, start):
    docs = brute.documents(spark)
    out = substring_dedup.dedup_substrings(docs, length, start)
    assert out.columns == [c for c in docs.columns if c != "n_words"] + ["n_words", "n_removed"]
    brute.alike(out.select("doc_id", "text", "n_words", "n_removed").collect(), brute.kept_words(brute.corpus(), length))


def test_substrings_of_nothing(spark):
    docs = brute.documents(spark).where("doc_id > 1000")
    assert substring_dedup.dedup_substrings(docs).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(docs, 5, 5)


def test_near_duplicates(spark):
    out = minhash.near_duplicates(brute.documents(spark))
    brute.alike(out.select("doc_id", "n_shingles", "component_id", "kept").collect(), brute.components(brute.corpus()))


def test_near_duplicate_chain_in_blocks(spark):
    """Links that no smallest member of a band has, found in blocks of a few documents."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i: 3 * i + 60])) for i in range(60)] + [(100 + i, " ".join(words[200: 245] + [f"x{i}{j}" for j in range(25)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = docs.withColumnRenamed("doc_id", "_n")
    reps = minhash.sketches(numbered)
    links = minhash.link_representatives(reps, numbered, chunk=300).collect()
    sets = {i: brute.shingles(t) for i, t in rows}
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    want = brute.components([(i, t) for i, t in rows])
    brute.alike(minhash.near_duplicates(docs).drop("_n").collect(), want)


def test_keep_one_of_each(spark):
    docs = brute.documents(spark)
    out = minhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r[3] for r in brute.components(brute.corpus()))
    assert minhash.keep_one_of_each(docs.where("doc_id > 1000")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    both = np.concatenate([np.sort(a[:1500]), np.sort(a[500:])])
    signature = sketches.signatures(both, np.array([0, 1500, 3000]), 1024)
    assert abs((signature[0] == signature[1]).mean() - 0.5) < 0.06


def test_words_and_windows():
    text = "a bb\tccc\nd\x0be \u00a0f".encode()
    raw, starts, ends, hashes, first = arrays.block_words([text, b"", b"bb  a"])
    assert [raw[s:e].tobytes() for s, e in zip(starts, ends)] == text.split() + [b"bb", b"a"]
    assert hashes[0] == hashes[-1] and hashes[1] == hashes[-2] and len(set(hashes.tolist())) == len(text.split())
    assert first.tolist() == [0, 6, 6, 8]
    values = np.array([3, 1, 2, 1, 5, 0, 0, 9], np.uint64)
    assert arrays.sliding_argmin(values, 3).tolist() == [1, 1, 3, 5, 5, 5]
    assert arrays.sliding_argmin(values, 3, rightmost=True).tolist() == [1, 3, 3, 5, 6, 6]


def test_components_of_small_and_large_graphs(spark):
    from tablewright.llm.components import components

    links = [(5, 3), (3, 9), (3, 3), (7, 8), (9, 5), (20, 21), (21, 22), (22, 23), (23, 24)]
    df = spark.createDataFrame(links, "a long, b long")
    want = [(3, 3), (5, 3), (9, 3), (7, 7), (8, 7), *[(n, 20) for n in range(20, 25)]]
    brute.alike(components(df).collect(), want)
    brute.alike(components(df, one_task=0).collect(), want)
    assert components(df.where("a > 100")).count() == 0 and components(df.where("a > 100"), one_task=0).count() == 0
