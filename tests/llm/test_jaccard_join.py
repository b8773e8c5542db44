"""The count-vector R-tree join against comparing all pairs."""

import random

import brute
import numpy as np
import pytest

from tablewright.llm import count_tree, jaccard_join, sketches


def shingles(text, size=3):
    w = [x.translate(brute.LOWER) for x in brute.words(text)]
    return frozenset(tuple(w[i: i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain(rows, percent=90, size=3):
    rows = brute.order(rows)
    sets, above = [shingles(r[1], size) for r in rows], list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                above[y] = x
    return [(r[0], len(s), rows[top(i)][0]) for i, (r, s) in enumerate(zip(rows, sets))]


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"z{rng.random()}"
        out.append(" ".join(copy))
    return out


def random_sets(rng, n, most):
    """Sets as numbers, many of them near one of a few others."""
    bases = [rng.sample(range(1 << 40), rng.randint(1, most)) for _ in range(max(1, n // 8))]
    sets = []
    for _ in range(n):
        items = list(rng.choice(bases))
        for _ in range(rng.randint(0, 1 + len(items) // 12)):
            items[rng.randrange(len(items))] = rng.randrange(1 << 40)
        sets.append(np.unique(np.array(items, np.uint64)))
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), sets


@pytest.mark.parametrize("percent, most", [(90, 12), (90, 60), (90, 400), (75, 80), (50, 30)])
def test_linked_sets_have_a_group_in_common(percent, most):
    values, first, sets = random_sets(random.Random(most), 240, most)
    owner, keys = jaccard_join.group_keys(values, first, percent)
    own = [set() for _ in sets]
    for i, k in zip(owner.tolist(), keys.tolist()):
        own[i].add(k)
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(a, sets[j]))
            if count_tree.reaches(shared, len(a), len(sets[j]), percent):
                linked += 1
                assert own[i] & own[j]
    assert linked > 50


@pytest.mark.parametrize("n, most", [(1, 5), (16, 40), (17, 40), (300, 25), (500, 200)])
def test_tree_finds_what_the_bound_allows(n, most):
    values, first, sets = random_sets(random.Random(n), n, most)
    points = count_tree.count_vectors(values, first)
    assert points.sum() == len(values)
    labels = np.arange(n) % 5
    query, member = count_tree.CountTree(points, 90).candidates(points, labels, labels)
    found = set(zip(query.tolist(), member.tolist()))
    assert len(found) == len(query)
    for i in range(n):
        for j in range(n):
            bound = int(np.minimum(points[i], points[j]).sum())
            assert bound >= len(np.intersect1d(sets[i], sets[j]))
            a, b = len(sets[i]), len(sets[j])
            want = labels[i] != labels[j] and count_tree.reaches(bound, a, b, 90) and min(a, b) * 100 >= max(a, b) * 90
            assert ((i, j) in found) == want


def test_corpus(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [r[:2] for r in brute.corpus()] + [(2000 + i, t) for i, t in enumerate(variants(rng, base, 40, 7) + variants(rng, base[:30], 20, 1))]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, component_id string, point string, `size` int").repartition(3)
    brute.alike(jaccard_join.jaccard_components(docs).collect(), plain(rows))


@pytest.mark.parametrize("percent", [90, 60])
def test_chain_in_small_chunks(spark, percent):
    """Neighbours of a chain are linked to each other only; the smallest member of a block links few of them."""
    words = [f"w{i}" for i in range(600)]
    step = 2 if percent == 90 else 9
    rows = [(i, " ".join(words[step * i: step * i + 82])) for i in range(50)]
    rows += [(100 + i, " ".join(words[300:360] + [f"x{i}{j}" for j in range(15)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, percent)
    assert len({r[2] for r in want}) < len(want)
    brute.alike(jaccard_join.jaccard_components(docs, percent=percent, chunk=900).collect(), want)


def test_links_are_true_and_connect(spark):
    rng = random.Random(9)
    rows = list(enumerate(variants(rng, [f"w{i}" for i in range(90)], 60, 6)))
    numbered = spark.createDataFrame(rows, "_n long, text string")
    reps = jaccard_join.sketches(numbered, 3, 90)
    sets = {i: shingles(t) for i, t in rows}
    links = jaccard_join.link_classes(reps, numbered, chunk=2000).collect()
    assert links and all(100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) for a, b in links)


def test_nothing_and_wrong_percent(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (None, "a")], "doc_id long, text string")
    brute.alike(jaccard_join.jaccard_components(docs).collect(), [(1, 0, 1), (2, 0, 2), (None, 1, None)])
    assert jaccard_join.jaccard_components(docs.where("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        jaccard_join.jaccard_components(docs, percent=0)


def test_sets_of_a_block_agree_with_plain_ones():
    texts = ["a b c d a b c", "A b C", "a", "", "a b"]
    _, first = sketches.shingle_sets([t.encode() for t in texts], 3)
    assert np.diff(first).tolist() == [len(shingles(t)) for t in texts]
