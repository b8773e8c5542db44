"""Fingerprints, tokens, languages, licenses and mixing."""

import hashlib
import random

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import bpe, langid, licenses, mixing, winnowing
from tablewright.llm.queries import ORACLES, tokenizer_path

PATH = tokenizer_path(bpe.VOCABULARY)


def plain_winnow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    if not text:
        return []
    points = winnowing.code_points(text)
    if len(text) < gram:
        points = np.concatenate([points, np.full(gram - len(text), 0x110000, np.uint32)])
    hashes = [int(winnowing.rolling(points[i: i + gram], gram)[0]) for i in range(len(points) - gram + 1)]
    kept = set()
    for i in range(max(1, len(hashes) - window + 1)):
        run = hashes[i: i + window]
        kept.add(i + max(j for j, h in enumerate(run) if h == min(run)))
    return [(hashes[i], i) for i in sorted(kept)]


def plain_text(text):
    marks = plain_winnow(text)
    return winnowing.as_text((np.array([h for h, _ in marks], np.uint64), np.array([i for _, i in marks], np.int64)))


def plain_likeness(a, b):
    x, y = {h for h, _ in plain_winnow(a)}, {h for h, _ in plain_winnow(b)}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("block", [1 << 19, 150])
def test_winnowing_is_exact(monkeypatch, block):
    monkeypatch.setattr(winnowing, "BLOCK_CHARS", block)
    rng = random.Random(3)
    texts = ["", "a", "ab" * 40, "x" * 300, "é日本" * 30] + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    for text, (hashes, places) in zip(texts, winnowing.fingerprints(texts, 8, 12)):
        assert list(zip(hashes.tolist(), places.tolist())) == plain_winnow(text, 8, 12)


def test_winnowing_guarantee():
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdef") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    a, b = winnowing.fingerprints(["q" * 200 + shared, shared + "z" * 300])
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_half_of_a_text_is_found(spark):
    rng = random.Random(7)
    rows = [(n, "".join(rng.choice("abcdefgh") for _ in range(n))) for n in list(range(46, 130)) + [200, 390]]
    out = winnowing.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r["near_edited"] > 0 for r in out)


def test_one_rule_at_every_length():
    """Texts that differ in a character at their end stay alike, whatever their length."""
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefgh") for _ in range(200))
    for n in range(30, 199):
        a, b = winnowing.fingerprints([text[:n], text[: n + 1]])
        assert winnowing.likeness(a, b) >= 0.5


@pytest.mark.parametrize("window", [1, 2, 16, 64, 65, 5000])
def test_fingerprints_as_text(window):
    rng = random.Random(window)
    texts = ["", "a", "ab" * 40] + ["".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 20_000))) for _ in range(5)]
    for mark in winnowing.fingerprints(texts, 8, window):
        hashes, places = winnowing.from_text(winnowing.as_text(mark, window), window)
        assert hashes.tolist() == mark[0].tolist() and places.tolist() == mark[1].tolist()


def test_edited_texts(spark):
    rows = brute.order(brute.corpus())
    texts = [r[1] or "" for r in rows]
    want = []
    for i, (row, text) in enumerate(zip(rows, texts)):
        following = texts[(i + 1) % len(rows)]
        half = len(text) // 2
        want.append((row[0], len(text), hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()))
    out = winnowing.compare_with_edits(brute.documents(spark))
    got = out.collect()
    # Rows of one doc_id may stand in any order where their texts are equal.
    brute.alike([tuple(r)[:3] for r in got], want)
    full = []
    for i, (row, text) in enumerate(zip(rows, texts)):
        following, half = texts[(i + 1) % len(rows)], len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        if len(text) < 5000:
            full.append((row[0], len(text), plain_text(text),
                         plain_likeness(text, changed), plain_likeness(text, following) if len(following) < 5000 else None))
    long = {f[:3] for f in full if f[4] is None}
    near = [(r["doc_id"], r["n_chars"], r["fingerprint"], r["near_edited"], None if (r["doc_id"], r["n_chars"], r["fingerprint"]) in long else r["near_next"])
            for r in got if r["n_chars"] < 5000]
    brute.alike(near, full)
    by_text = {}
    for r in out.join(brute.documents(spark).select("doc_id", "text"), "doc_id").where("n_chars = length(text)").collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    for r in got:
        by_text.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(by_text[0]) == 1
    one = brute.documents(spark).where("doc_id = 0").limit(1)
    assert winnowing.compare_with_edits(one).first()["near_next"] == 1.0
    assert winnowing.compare_with_edits(one.where("doc_id = 1")).count() == 0


def test_tokens_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    own = bpe.Encoder(PATH)
    rng = random.Random(5)
    texts = [r[1] or "" for r in brute.corpus()] + ["It's we'll <|endoftext|>x<|startoftext|> ΣΑΣ İ ﬁ Å e\u0301 12½ %%%$$ a\x1cb\u200b\u3000c 'S"]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 5, 33, 64, 65, 700) for letters in ("ab", "theandoru", "éèñ日本", "a")]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == want
        assert bpe.decode(own.vocabulary, want) == library.decode(want, skip_special_tokens=False)
    out = bpe.encode_documents(brute.documents(spark), PATH, with_ids=True).collect()
    want = []
    for row in brute.corpus():
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((row[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    brute.alike(out, want)
    assert bpe.encode_documents(brute.documents(spark).where("doc_id > 1000"), PATH).count() == 0


def test_long_runs_are_streamed(monkeypatch):
    """A run without white space that is longer than a chunk, and decoding in lots, against the library."""
    monkeypatch.setattr(bpe, "CHUNK", 50)
    library, own = Tokenizer.from_file(PATH), bpe.Encoder(PATH)
    rng = random.Random(8)
    for text in ("".join(rng.choice("thearnding'.,12é") for _ in range(3000)), "a" * 20_000, "x" * 130 + " tail"):
        want = library.encode(text, add_special_tokens=False).ids
        assert own.ids(text) == want
        decoder, at, out = bpe.Decoder(own.vocabulary), 0, ""
        while at < len(want):
            step = rng.randint(0, 40)
            out, at = out + decoder.feed([str(i) for i in want[at: at + step]]), at + step
        assert out + decoder.finish() == library.decode(want, skip_special_tokens=False)
    decoder = bpe.Decoder(own.vocabulary, plain=False)
    assert decoder.feed([str(i) for i in own.ids("naïve 日本")]) + decoder.finish() == bpe.decode(own.vocabulary, own.ids("naïve 日本"), plain=False)


def test_merges_agree_with_the_transducer():
    vocabulary = bpe.Vocabulary(PATH)
    rng = random.Random(6)
    for n in (1, 2, 9, 40, 300):
        word = "".join(rng.choice("thearnding") for _ in range(n))
        symbols = list(vocabulary.symbols(word))
        parts, texts = list(symbols), vocabulary.tokens
        while True:
            pairs = [(vocabulary.ranks.get((vocabulary.ids[a], vocabulary.ids[b]), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            if not pairs or min(pairs)[0] == 1 << 60:
                break
            i = min(pairs)[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        assert [texts[t] for t in bpe.transduce(vocabulary, symbols)] == parts
    # A long word leaves the transducer while it is still being read.
    read = []
    stream = bpe.transduce(vocabulary, (read.append(s) or s for s in vocabulary.symbols("thing" * 2000)))
    next(stream)
    assert len(read) < 20 * vocabulary.lookahead


def test_bytes_to_text():
    vocabulary = bpe.Vocabulary(PATH)
    encoder = bpe.Encoder(PATH)
    assert bpe.decode(vocabulary, encoder.ids("Été 日本 a"), plain=False) == "été 日本 a "
    machine = bpe.Decoder(vocabulary, plain=False)
    for raw in (b"\xff\xc3a", "é𝄞".encode(), b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf"):
        assert "".join(map(machine._byte, raw)) + machine.finish() == raw.decode("utf-8", "replace")


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, rows_per_language=80)
    out = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(out) > 200 and (out["lang"] == out["lang_pred"]).mean() > 0.97
    odd = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0.0) for r in langid.identify(brute.documents(spark), model).collect()}
    wanted = {(r[0], not any(map(str.isalpha, r[1] or "")), not any(map(str.isalpha, r[1] or ""))) for r in brute.corpus()}
    assert odd == wanted
    kept = langid.keep_identified(brute.documents(spark), model)
    assert kept.columns == brute.documents(spark).columns and kept.count() == sum(any(map(str.isalpha, r[1] or "")) for r in brute.corpus())
    unlabelled = brute.documents(spark).where("lang is null")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.keep_identified(unlabelled).count() > 0
    assert langid.identify(docs.limit(0)).count() == 0


def test_scores_equal_a_plain_forward_pass():
    """Every filter at every place of every window, one by one, and windows weighed by their bytes."""
    texts = ["le chat et la souris, " * 40, "the cat", "ünd die Katze " * 25 + "x", "a" * langid.WINDOW, "b" * (langid.WINDOW + 1)]
    model = langid.train(texts[:3] * 2, ["fr", "en", "de"] * 2, steps=20)
    scores = langid.Scorer(model).predict(texts)
    for text, name, score in zip(texts, scores["lang_pred"], scores["score"]):
        raw = text.encode()
        total = np.zeros(3)
        for low in range(0, len(raw), langid.WINDOW):
            window = raw[low: low + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            peaks = [max(sum(table[j][window[i + j]][f] for j in range(len(table))) for i in range(langid.WINDOW - len(table) + 1))
                     for table in model.tables for f in range(langid.FILTERS)]
            hidden = np.maximum(np.array(peaks) + model.bias, 0)
            total += (hidden @ model.weights + model.offsets) * min(langid.WINDOW, len(raw) - low) / len(raw)
        p = np.exp(total - total.max())
        p /= p.sum()
        assert name == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_training_reads_all_of_a_text(spark):
    """Letters that stand in the last part of long texts alone are learnt."""
    rows = [(i, "0 " * 4000 + ("aab " if i % 2 else "zzy ") * 4000, "ab" if i % 2 else "zy") for i in range(60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_language=20)
    assert langid.Scorer(model).predict(["aab aab aab", "zzy zzy"])["lang_pred"].tolist() == ["ab", "zy"]


def test_network_gradient():
    rng = np.random.default_rng(1)
    model = langid.train(["abc abc"] * 4 + ["xyz xyz"] * 4, ["a"] * 4 + ["b"] * 4, steps=60)
    assert langid.Scorer(model).predict(["abcabc", "xyz", None, "12"])["lang_pred"].tolist() == ["a", "b", "und", "und"]
    params = [*model.tables, model.bias, model.weights, model.offsets]
    params = [p.astype(np.float64) for p in params]
    x, y = rng.integers(1, 255, (5, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1])

    def loss() -> float:
        best = np.concatenate([sum(t[j][x[:, j: j + 40 - len(t) + 1]] for j in range(len(t))).max(axis=1) for t in params[:3]], axis=1)
        p = langid.softmax(np.maximum(best + params[3], 0) @ params[4] + params[5])
        return -np.log(p[np.arange(5), y]).mean()

    grads = langid._gradients(params, x, y)
    for p, g in zip(params, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before, p[at] = loss(), p[at] + 1e-6
        assert abs((loss() - before) / 1e-6 - g[at]) < 1e-3
        p[at] -= 1e-6


def test_licenses(spark):
    import duckdb
    import pandas as pd

    extra = [(200, "x Licensed under\nthe MIT\tLicense. mit license MIT LICENSE!"), (201, "CC-BY cc by"), (202, "Released under this MIT License"),
             (203, "Redistribution and use in source and binary forms with or without modification are permitted if the following conditions are met"),
             (204, "apache\u00e9 license"), (205, "GNU General Public License" * 3), (206, ("word " * 500 + "\n") * 40 + "Released under the MIT License.")]
    rows = [r[:2] for r in brute.corpus()] + extra
    docs = spark.createDataFrame([r + ("x", "y") for r in rows], "doc_id long, text string, held string, token string")
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = db.execute(ORACLES["op5_license_set_join"]).fetchall()
    brute.alike(licenses.scan_licenses(docs).collect(), want)
    assert licenses.scan_licenses(docs.where("doc_id < 0")).count() == 0


def test_licenses_wrapped(spark):
    import textwrap

    def wrap(text, lead):
        return "Some header\n" + "".join(f"{lead}{line}\n" for line in textwrap.wrap(text, 70)) + "int main() {}"

    labels = [label for label, _ in licenses.TEMPLATES]
    leads = ["", " * ", "rem "]
    rows = [(10 * i + j, wrap(text, lead)) for i, (_, text) in enumerate(licenses.TEMPLATES) for j, lead in enumerate(leads)]
    # One word a line; the same tokens, but too far apart for one notice; a notice between two others.
    bsd = dict(licenses.TEMPLATES)["bsd"]
    rows += [(900, bsd.replace(" ", "\n")), (901, ("\n" + "filler " * 4).join(bsd.split())), (902, wrap(" ".join(t for _, t in licenses.TEMPLATES[7:]), ""))]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(labels):
        for j in range(len(leads)):
            assert label in got[10 * i + j]["labels"].split(",") and got[10 * i + j]["score"] == 1.0, (label, leads[j])
    assert (got[900]["labels"], got[900]["score"]) == ("bsd", 1.0) and (got[901]["labels"], got[901]["score"]) == ("", 0.0)
    assert set(labels[7:]) <= set(got[902]["labels"].split(","))


def test_targets():
    plans = {p.source: p for p in mixing.targets({"b": 100, "a": 10, None: 1000, "c": 0})}
    assert plans["a"].target == 20 and plans["c"].target == 0 and plans["b"].target == 200
    assert sum(p.target for p in plans.values()) == pytest.approx(1.5 * 1110)
    assert mixing.targets({}) == [] and mixing.targets({None: 0})[0].target == 0


def test_split_quotas():
    out = mixing.split_quotas([1000, 37, 0, 5], 7, seed=2)
    assert out.sum(axis=1).tolist() == [1000, 37, 0, 5] and np.ptp(out.sum(axis=0)) <= 1 and (out >= 0).all()
    assert (out == mixing.split_quotas([1000, 37, 0, 5], 7, seed=2)).all()
    huge = mixing.split_quotas([5 * 10**9, 10**9], 4)
    assert huge.sum(axis=1).tolist() == [5 * 10**9, 10**9]
    # A shard's share of a source scatters as a draw without replacement does.
    first = [mixing.split_quotas([600, 400], 4, seed=s)[0, 0] for s in range(300)]
    assert abs(np.mean(first) - 150) < 2 and 5 < np.std(first) < 9


@pytest.mark.parametrize("block", [4, None])
def test_mix(spark, block):
    rows = brute.corpus()
    docs = brute.documents(spark)
    out = mixing.mix_report(docs, block_words=block, shards=5).collect()
    brute.alike([(r["doc_id"], r["size"]) for r in out], [(r[0], len(brute.words(r[1]))) for r in rows])
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    again = mixing.mix_report(docs.repartition(7, "text"), block_words=block, shards=5).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    if block:
        for target, size in {(r["target"], r["source_size"]) for r in out}:
            taken = sum(r["taken"] for r in out if (r["target"], r["source_size"]) == (target, size))
            assert abs(taken - target) <= 0.5 + 1e-9
    assert mixing.mix_report(docs.where("doc_id > 1000")).count() == 0


def test_mix_takes_the_first_of_each_order(spark):
    """Words taken per document against walking the hash order of each source in plain Python."""
    from pyspark.sql import functions as F
    from tablewright.runtime import cut

    sized = cut(mixing.sized_rows(brute.documents(spark)))
    blocks = sized.where("size > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / 4))))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(7), "_k1", "_k2", "_copy", "b")).collect()
    wanted = {}
    for source in {r["source"] for r in blocks}:
        own = sorted((r for r in blocks if r["source"] == source), key=lambda r: (r["h"] % (1 << 64), r["h"], r["_k1"], r["_k2"], r["_copy"], r["b"]))
        sizes = {s: sum(r["size"] for r in sized.collect() if r["source"] == s) for s in {r["source"] for r in sized.collect()}}
        left = round(next(p.target for p in mixing.targets(sizes) if p.source == source))
        while left > 0:
            for r in own:
                words = min(4, r["size"] - 4 * r["b"], left)
                key = (r["_k1"], r["_k2"], r["_copy"])
                wanted[key] = wanted.get(key, 0) + words
                left -= words
                if not left:
                    break
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], wanted.get((r["_k1"], r["_k2"], r["_copy"]), 0)) for r in sized.collect())
    out = mixing.mix_report(brute.documents(spark), block_words=4, shards=5).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["taken"]) for r in out) == want
    assert all((r["pieces"] > 0) == (r["taken"] > 0) and r["shards"] <= min(5, r["pieces"]) for r in out)


def test_draws_beyond_numpy_follow_the_same_law():
    rng = np.random.default_rng(1)
    own = np.array([mixing._inverted(u, 300, 500, 200) for u in rng.random(20_000)])
    theirs = rng.hypergeometric(300, 500, 200, 20_000)
    assert abs(own.mean() - theirs.mean()) < 0.15 and abs(own.std() - theirs.std()) < 0.15
    assert {mixing._inverted(u, 3, 2, 4) for u in (0.0, 0.3, 0.61, 0.9999)} == {2, 3}
    large = [mixing._inverted(u, 4 * 10**11, 6 * 10**11, 10**10) for u in (0.001, 0.5, 0.999)]
    spread = (10**10 * 0.4 * 0.6 * 0.99) ** 0.5
    assert abs(large[1] - 4 * 10**9) < spread / 100 and abs((large[2] - large[0]) / spread - 2 * 3.0902) < 0.01


def test_mix_shards_and_documents(spark):
    docs = brute.documents(spark)
    from tablewright.runtime import cut

    taken, plans = mixing.draw(cut(mixing.sized_rows(docs)), 4, 5)
    sizes = [r["n"] for r in taken.groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert taken.groupBy("_k1", "_k2", "_copy", "first_word", "pass").count().where("count > 1").count() == 0
    written = mixing.write_shards(taken, 5, rows=20)
    assert sorted(map(str, written.select(taken.columns).collect())) == sorted(map(str, taken.collect()))
    assert written.select("shard", "part").distinct().count() > 5
    mixed = mixing.mix_documents(docs, shards=3)
    assert mixed.columns == docs.columns and mixed.subtract(docs).count() == 0
