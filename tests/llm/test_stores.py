"""Archives, url verdicts, nearest neighbours and the whole pipeline."""

import hashlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from tablewright.llm import ann, url_graph, warc


def pages(spark):
    big = "<p>" + "é" * 700
    rows = [(1, "http://a/x", big, "q"), (5, None, big, "q"), (3, "http://b/\r\ny", big, "q"), (2, "http://c", "small", "q"), (4, "http://c", "small", "q"),
            (6, "http://d", None, "q"), (7, "", "", "q"), (8, "http://e", "x" * 3_000_000, "q"), (9, "http://f", "y" * 999, "q"), (10, "http://f", "y" * 999, "q"),
            (11, "g", "z" * 1000, "q"), (12, "g", "z" * 1000, "q"), (12, "g", "z" * 1000, "q"), (None, "h", "z" * 1000, "q"), (None, "i", "only" * 300, "q")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)


def test_archives(spark):
    rows, df = pages(spark)
    want = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        owner = max(same) if len(raw) >= 1000 and same else page_id
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if owner == page_id else "revisit", None if owner == page_id else owner))
    brute.alike(warc.archive_round_trip(df).collect(), want)
    assert warc.archive_round_trip(df.where("page_id > 99")).count() == 0


def test_frames_stand_alone(spark, tmp_path):
    import zstandard

    _, df = pages(spark)
    index = warc.write_archives(df.coalesce(1), str(tmp_path / "out"), frame_bytes=2000, bundle_bytes=200).collect()
    assert len({r["path"] for r in index}) > 1 and len({(r["path"], r["frame"]) for r in index}) > 4
    for row in index:
        with open(row["path"], "rb") as file:
            file.seek(row["frame_at"])
            plain = zstandard.ZstdDecompressor().decompress(file.read(row["frame_bytes"]))
        record = plain[row["record_at"]: row["record_at"] + row["record_bytes"]]
        assert record.startswith(b"WARC/1.1\r\n") and warc.parse_record(record)[0] == row["page_id"]
    # The footer is a skippable frame: plain decoders read through the whole bundle.
    with open(index[0]["path"], "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert len(whole) == sum(r["record_bytes"] for r in index if r["path"] == index[0]["path"])


def test_reading_tasks_follow_the_frames(spark, tmp_path, monkeypatch):
    rows = [(i, "http://a.org/", "".join(chr(97 + (i * 7 + j * j) % 26) for j in range(3000))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_archives(df.coalesce(1), str(tmp_path / "out"), frame_bytes=8000, bundle_bytes=60_000)
    size = sum(r["n"] for r in index.groupBy("path", "frame").agg({"frame_bytes": "max"}).toDF("path", "frame", "n").collect())
    monkeypatch.setattr(warc, "READ_BYTES", size // 6)
    read = warc.read_archives(index)
    assert read.rdd.getNumPartitions() in (6, 7) and sorted(r["page_id"] for r in read.collect()) == list(range(40))


def test_url_parts_and_rules(spark):
    cases = [("HTTP://WWW.Org/a?x#y", "www.org", "/a", "org/", "allow"), ("http://orgs/", "orgs", "/", None, "allow"), (None, "", "", None, "allow"), ("no host", "", "", None, "allow"),
             ("x://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
             ("http://a.example.org/en/2", "a.example.org", "/en/2", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
             ("http://x.com/de/?q", "x.com", "/de/", "com/de/", "block"), ("http://x.com/de", "x.com", "/de", None, None), ("http://É.net#://b", "É.net", "", None, "allow")]
    df = spark.createDataFrame([(i, c[0], None, "z") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    for row in url_graph.judge_urls(df).collect():
        _, host, path, rule, verdict = cases[row["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert verdict is None or row["verdict"] == verdict
    assert url_graph.judge_urls(df.where("page_id < 0")).count() == 0


def test_propagation(spark):
    names = [f"h{i}" for i in range(7)]
    links = {(0, 1): 2, (0, 2): 1, (1, 2): 3, (2, 0): 1, (3, 4): 1, (5, 3): 2, (1, 5): 1, (6, 0): 1}
    html = lambda i: "".join(f'<a HREF="//{names[b].upper()}/p">x</a>' * n for (a, b), n in links.items() if a == i) + '<img src="/own"><a href="http://h%d/z">' % i
    df = spark.createDataFrame([(i, f"http://{names[i]}/{'t' if i == 0 else 'b' if i == 4 else 'n'}", html(i)) for i in range(7)], "page_id long, url string, html string")
    rules = (("h0/t", "allow"), ("h4/b", "block"))

    def walk(edges, seed):
        m = np.zeros((7, 7))
        for (a, b), n in edges.items():
            m[b, a] = n
        out = m.sum(axis=0)
        s = seed.copy()
        for _ in range(300):
            moved = m @ np.divide(s, out, where=out > 0, out=np.zeros(7))
            s = 0.85 * moved + (1 - 0.85 * moved.sum()) * seed
        return s

    trust = walk(links, np.eye(7)[0])
    distrust = walk({(b, a): n for (a, b), n in links.items()}, np.eye(7)[4])
    out = {r["page_id"]: r for r in url_graph.judge_urls(df, rules, threshold=1e-3, tolerance=1e-3).collect()}
    for i in range(7):
        assert out[i]["trust"] == pytest.approx(trust[i], abs=0.01) and out[i]["distrust"] == pytest.approx(distrust[i], abs=0.01)
        expected = {0: "allow", 4: "block"}.get(i) or ("allow" if trust[i] - distrust[i] > 1e-3 else "block")
        assert out[i]["verdict"] == expected
    assert {r["verdict"] for r in out.values()} == {"allow", "block"}


def test_far_hosts_are_reached_whatever_the_number_of_seeds(spark):
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(4)], "src string, dst string, n long")
    marked = spark.createDataFrame([("h0", 1, 0), ("large", 5_000_000, 0), ("h4", 0, 1)], "host string, trusted long, blocked long")
    scores = {r["host"]: r for r in url_graph.propagate(edges, marked, tolerance=0.5).collect()}
    assert all(scores[f"h{i}"]["trust"] > 0 and scores[f"h{i}"]["distrust"] > 0 for i in range(5))
    assert scores["h3"]["trust"] == pytest.approx(0.85 * scores["h2"]["trust"])


def vectors(spark, n=2000, d=24):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[300:340] = x[300]
    rows = [(i, [float(np.float32(v)) for v in x[i]], "l") for i in range(n)]
    odd = [(n, None, "l"), (n + 20, [0.0] * d, "l"), (n + 40, [float("nan")] + [1.0] * (d - 1), "l"), (n + 60, [None] + [1.0] * (d - 1), "l"),
           (n + 80, [float("inf")] * d, "l"), (None, [1.0] * d, "l"), (n + 100, [1.0] * (d - 1), "l"), rows[7], rows[40]]
    return dict((r[0], np.array(r[1])) for r in rows), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, list string").repartition(4)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_CHUNK", 60)
    monkeypatch.setattr(ann, "QUERY_CHUNK", 40)
    known, df = vectors(spark)
    ids, x = np.array(list(known)), np.stack(list(known.values()))
    found, wanted = 0, 0
    rows = ann.nearest(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in known if i % 20 == 0}
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        for r in own:
            assert r["score"] == pytest.approx(float(known[q] @ known[r["vec_id"]]), rel=1e-12, abs=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        score = np.where(ids == q, -np.inf, x @ known[q])
        top = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        found, wanted = found + len(top & {r["vec_id"] for r in own}), wanted + 20
    assert found / wanted >= 0.9


def test_few_vectors(spark):
    _, df = vectors(spark)
    few = df.where("vec_id < 5")
    assert [(r["query_id"], r["rank"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, i) for i in range(1, 5)]
    assert ann.nearest(df.where("vec_id is null")).count() == 0 and ann.nearest(df.where("vec_id = 3")).count() == 0


def test_pipeline(spark):
    """Every stage against its plain version, on the output of the one before."""
    docs = spark.createDataFrame([r[:5] for r in brute.corpus()], "doc_id long, text string, lang string, source string, n_chars long")
    steps = dict(corpus_pipeline.STAGES)
    first = steps["language_id"](spark, docs, "").collect()
    assert sorted(map(str, first)) == sorted(str(r) for r in docs.collect() if any(map(str.isalpha, r["text"] or "")))
    second = steps["near_dedup"](spark, spark.createDataFrame(first, docs.schema), "").collect()
    kept = [r for r, c in zip(brute.order([tuple(r) for r in first]), brute.components([tuple(r) for r in first])) if c[3]]
    assert sorted(map(str, map(tuple, second))) == sorted(map(str, kept))
    third = steps["substring_dedup"](spark, spark.createDataFrame(second, docs.schema), "").collect()
    want = [(d, t, len(t)) for d, t, n, gone in brute.kept_words([tuple(r) for r in second], 20) if n == 0 or gone < n]
    brute.alike([(r["doc_id"], r["text"], r["n_chars"]) for r in third], want)
    mixed = steps["mixing"](spark, spark.createDataFrame(third, docs.schema), "")
    fourth = mixed.collect()
    assert mixed.columns == docs.columns and {str(r) for r in fourth} <= {str(r) for r in third}
    assert max(sum(str(r) == str(x) for r in fourth) for x in third) <= 2
    fifth = steps["bpe"](spark, spark.createDataFrame(fourth, docs.schema), "").collect()
    assert len(fifth) == len(fourth) and all(len(r["ids"]) == r["n_tokens"] for r in fifth)
    assert [name for name, _ in corpus_pipeline.STAGES] == list(steps) and len(steps) == 5
