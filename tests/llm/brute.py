"""Plain versions of the text operators for small inputs, and the fixtures they share."""

from __future__ import annotations

import random

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _n string, runs string, shard string, "
          "label string, others string, size string, _copy string, n_words string, _ string, `a``b.c` string")


def corpus(seed: int = 1) -> list[tuple]:
    """Documents with null, empty, blank, short and very long texts, copies, near copies, shared passages and repeated rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["tha", "er", "ou", "ing", "st", "a", "ñe", "Ü", "re"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base, long = text(45), text(120), text(30_000)
    texts = [None, "", " \t\n", "One", "one two three", "ONE two three", "123 %%% 4", text(19), text(20), passage, text(60) + "\n" + passage + " " + text(40),
             passage + " " + text(8), base, base, base.upper(), base.replace(" ", "\n"), long, text(50) + " " + long[:5000], "the the " * 40, "the the " * 60]
    for _ in range(8):
        words = base.split(" ")
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [text(rng.randint(5, 90)) for _ in range(30)]
    langs, sources = ["en", "fr", None], ["a", "b", "ö", None]
    rows = [(7 * i % 101, t, langs[i % 3], sources[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, passage, "en", None, 0), (None, None, None, None, None), (rows[13][0], text(25), "fr", "a", 1)]
    return [r + ("x",) * 10 for r in rows]


def documents(spark, seed: int = 1):
    return spark.createDataFrame(corpus(seed), SCHEMA).repartition(3)


def order(rows: list[tuple]) -> list[tuple]:
    """Documents as the operators order them: by doc_id, nulls first, then by text, nulls first."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def words(text) -> list[bytes]:
    return text.encode().split() if text else []


def kept_words(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, kept text, words, removed) with every window looked up in a set."""
    seen, out = set(), []
    for doc_id, text in [r[:2] for r in order(rows)]:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i: i + length])
            if window in seen:
                gone[i: i + length] = [True] * length
            seen.add(window)
        out.append((doc_id, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return out


def shingles(text) -> frozenset:
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set size, component's doc_id, kept) by comparing all pairs."""
    rows = order(rows)
    sets = [shingles(r[1]) for r in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                above[y] = x
    return [(r[0], len(s), rows[top(i)][0], top(i) == i) for i, (r, s) in enumerate(zip(rows, sets))]


def alike(got, want) -> None:
    key = lambda r: tuple((v is not None, v) for v in r)
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b
