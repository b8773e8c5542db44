"""Large-table paths and edge cases, against brute force on small fixtures."""

import itertools
import math

import numpy as np
import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import casts
from tablewright.functions.blocks import Screen, distances, product_distances, smallest
from tablewright.functions.text import json_object, strip_fence
from tablewright.operators import charts, cleaning, features, metrics, profile, statistics
from tablewright.operators.components import connected_components
from tablewright.operators.lookup import lookup
from tablewright.operators.neighbours import nearest_neighbours
from tablewright.operators.ordering import with_position
from tablewright.operators.pivots import PivotTree
from tablewright.operators.proximity import widest, within
from tablewright.operators.silhouette import silhouette
from tablewright.operators.split import exact_split
from tablewright.plans.clean import clean, clean_all
from tablewright.plans.features import build_features
from tablewright.sources import tables
from tablewright.spec import DatasetSpec, route_columns


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_points(n, d, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 3)
    if copies:  # one point holds a third of all rows
        x[:copies] = x[0]
    return x


# ---- statistics -----------------------------------------------------------

@pytest.mark.parametrize("sort_rows,accuracy", [(1, 20), (5, 50), (200_000, 10_000)])
@pytest.mark.parametrize("n,hot", [(1, 0), (2, 0), (501, 0), (1000, 400), (1000, 1000)])
def test_median_by_narrowing(spark, sort_rows, accuracy, n, hot):
    rng = np.random.default_rng(n)
    values = np.where(np.arange(n) < hot, 3.25, rng.lognormal(0, 3, n))
    df = frame(spark, [(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = statistics.medians(df, ["v"], sort_rows=sort_rows, accuracy=accuracy)["v"]
    assert got == pytest.approx(float(np.median(values)), abs=0)


def test_median_of_nothing(spark):
    assert statistics.medians(frame(spark, [(None,)], "v double"), ["v"]) == {"v": None}


def test_modes_of_every_type(spark):
    df = spark.sql("""select * from values
        (1, 1.5D, 'b', date'2020-01-02', timestamp'2020-01-01 10:00:00', true, interval '1' day),
        (2, 1.5D, 'a', date'2020-01-02', timestamp'2020-01-01 10:00:00', true, interval '1' day),
        (2, 2.5D, 'a', date'2020-01-01', null, false, interval '2' day),
        (1, null, 'b', null, null, null, null) as t(i, d, s, dt, ts, b, iv)""")
    found = statistics.modes(df, df.columns)
    row = spark.range(1).select(*[m.value.alias(c) for c, m in found.items()]).first()
    assert (row.i, row.d, row.s, row.b) == (1, 1.5, "a", True)
    assert str(row.dt) == "2020-01-02" and row.ts.hour == 10 and row.iv.days == 1
    assert found["i"].ties == 2 and found["s"].ties == 2 and found["d"].ties == 1


def test_exact_split_size(spark):
    df = spark.range(1001)
    for percentage in (0, 1, 30, 100):
        n = exact_split(df, "id", percentage).where("split = 'test'").count()
        assert n == math.ceil(1001 * percentage / 100)


# ---- casts ----------------------------------------------------------------

def one(spark, value, build, kind="string"):
    df = frame(spark, [(value,)], f"v {kind}")
    return df.select(build(F.col("v"), df.schema["v"].dataType).alias("r")).first().r


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 7 ", 7.0), ("x", None), ("1d", None), ("2f", None), ("nan", None),
                                       ("inf", math.inf), ("-1e3", -1000.0), ("", None), (None, None)])
def test_numbers(spark, text, want):
    assert one(spark, text, casts.to_number) == want


@pytest.mark.parametrize("text,seconds", [
    ("1 days 02:03:04", 93784), ("02:03:04", 7384), ("5", 0), ("3 days", 259200), ("soon", None), (None, None),
    ("-1 days", -86400), ("2h", 7200), ("1 min", 60), ("90 s", 90), ("1 day 00:00:01.5", 86401.5), ("5000000000", 5),
])
def test_timedelta(spark, text, seconds):
    got = one(spark, text, casts.to_timedelta)
    assert (None if got is None else got.total_seconds()) == seconds


@pytest.mark.parametrize("text,want", [
    ("1+2j", (1, 2)), ("3", (3, 0)), ("-1.5-2j", (-1.5, -2)), ("2j", (0, 2)), ("j", (0, 1)), ("1-j", (1, -1)), ("(1+2j)", (1, 2)), ("x", None), (None, None)])
def test_complex(spark, text, want):
    got = one(spark, text, lambda c, t: casts.to_complex(c))
    assert (None if got is None else tuple(got)) == want


def test_dates_by_format(spark):
    build = lambda c, t: casts.to_date(c, t).cast("string")
    assert one(spark, "2021-03-04 10:11:12", build) == "2021-03-04"
    assert one(spark, "03/05/2021", build) == "2021-03-05"
    assert one(spark, "never", build) is None
    only = lambda c, t: casts.to_date(c, t, ("dd/MM/yyyy",)).cast("string")
    assert one(spark, "03/05/2021", only) == "2021-05-03" and one(spark, "2021-05-03", only) is None


def test_whole_numbers_keep_their_digits(spark):
    df = frame(spark, [("9007199254740993",), ("x",)], "v string")
    got = cleaning.enforce_types(df, DatasetSpec(types={"v": "int"}))
    assert got.schema["v"].dataType.simpleString() == "bigint" and got.first().v == 9007199254740993


def test_uint_with_negatives_stays(spark):
    df = frame(spark, [("5",), ("-1",)], "v string")
    assert cleaning.enforce_types(df, DatasetSpec(types={"v": "uint"})).schema["v"].dataType.simpleString() == "string"


# ---- cleaning -------------------------------------------------------------

def test_handle_nulls_rules(spark):
    df = frame(spark, [(1.0, "a", "x", None), (2.0, None, "x", None), (None, "b", None, None), (5.0, "b", "y", None)],
               "n double, s string, c string, e string")
    spec = DatasetSpec(types={"n": "int", "s": "str", "c": "category"}, fill_empty_rows_using="median")
    got = sorted(tuple(r) for r in cleaning.handle_nulls(df, spec).collect())
    assert got == [(1, "a", "x"), (2, "b", "x"), (5, "b", "y")]
    filled = DatasetSpec(types=spec.types, fill_empty_rows_using="custom_value", fill_string_type_columns=True)
    assert sorted(tuple(r) for r in cleaning.handle_nulls(df, filled).collect()) == [
        (0, "b", "x"), (1, "a", "x"), (2, "b", "x"), (5, "b", "y")]
    none = DatasetSpec(types={"n": "float"}, fill_empty_rows_using="none")
    assert cleaning.handle_nulls(df.select("n"), none).count() == 3


def test_half_even_rounding(spark):
    df = frame(spark, [(0.5,), (1.5,), (2.5,), (-0.5,)], "v double")
    assert [r[0] for r in df.select(cleaning.round_whole(F.col("v"))).collect()] == [0, 2, 2, 0]


def test_nan_rows_are_duplicates(spark):
    df = frame(spark, [(float("nan"), "a"), (None, "a"), (1.0, "a"), (1.0, "a")], "v double, s string")
    assert cleaning.remove_duplicates(df).count() == 2


def test_clean_options(spark):
    df = frame(spark, [(float(i % 9), float(i % 9) * 2, "a" if i % 10 else "b", i) for i in range(100)], "x double, x2 double, y string, id long")
    spec = DatasetSpec(types={"x": "float", "x2": "float", "y": "category", "id": "int"}, target_column="y",
                       remove_highly_correlated_columns=True, increase_the_size_of_dataset=True, row_key=("id",))
    out = clean(df, spec)
    assert "x2" not in out.columns
    sizes = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert sizes["a"] == 90 and sizes["b"] == 90
    done = clean_all({"good": (df, spec), "bad": (df, DatasetSpec(types={"x": "float"}, date_formats=("a",), value_maps={"x": 3}, remove_highly_correlated_columns=None, target_column=None))},
                     lambda name, rows: rows.count())
    assert done["good"] == "done"


def test_single_row_and_constant(spark):
    df = frame(spark, [(4.0, "a")], "v double, s string")
    assert features.standardize(df, ["v"]).first().v == 0.0 and features.minmax(df, ["v"]).first().v == 0.0
    assert profile.profile(df).count() == 2


def test_profile_counts_nan_as_missing(spark):
    df = frame(spark, [(float("nan"), "a"), (0.0, None), (-0.0, "a")], "v double, s string")
    got = {r.column: (r.missing, r.unique) for r in profile.profile(df).collect()}
    assert got == {"v": (1, 1), "s": (1, 1)}


def test_infer_types(spark):
    df = frame(spark, [("1", "1.5", "true", "a", "1"), ("2", "3", "False", "b", None)], "i string, d string, b string, s string, n string")
    assert profile.infer_types(df) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "n": "double"}


# ---- sources --------------------------------------------------------------

def test_csv_tokens_and_gate(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,NA,"x, ""y"""\n2,n/a,null\n')
    got = tables.read_dataset(spark, str(path))
    assert [tuple(r) for r in got.collect()] == [(1, None, 'x, "y"'), (2, None, None)]
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "t.xlsx")


def test_versions(spark, tmp_path):
    base, raw = str(tmp_path / "set"), str(tmp_path / "raw.parquet")
    spark.range(3).write.parquet(raw)
    assert tables.load_best(spark, base, raw).count() == 3
    tables.write_version(spark.range(2), base, done=False)
    assert tables.load_best(spark, base, raw).count() == 3
    tables.write_version(spark.range(1), base, done=True)
    assert tables.load_best(spark, base, raw).count() == 1


# ---- positions, lookups, components ---------------------------------------

@pytest.mark.parametrize("small", [0, 100_000])
def test_positions(spark, small):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.position for r in with_position(df, ["v"], small=small).collect())


def test_lookup_beyond_broadcast(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 500).cast("string"))).alias("t"))
    df = df.union(spark.range(5).select("id", F.lit(None).cast("string")))
    table = df.where("t is not null").groupBy("t").agg(F.count("*").alias("n")).select(F.col("t").alias("k"), F.concat(F.lit("="), "t").alias("val"), "n")
    small = lookup(df, table, "t", "k", "val")
    large = lookup(df, table, "t", "k", "val", small=10)
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect())) and large.count() == 3005
    assert large.where("t is not null and (val is null or val <> concat('=', t))").isEmpty()


@pytest.mark.parametrize("hub_edges,small", [(10, 0), (1_000_000, 0), (1_000_000, 100_000)])
def test_components(spark, hub_edges, small):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(200, 400)] + [(500, int(v)) for v in range(501, 560)] + [
        (int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.component for r in connected_components(frame(spark, edges, "a long, b long"), hub_edges=hub_edges, small=small).collect()}
    assert got == {v: root(v) for v in linked}


def test_within(spark):
    x, y = random_points(80, 5, 1), random_points(60, 5, 2)
    left = frame(spark, [(i, p.tolist()) for i, p in enumerate(x)], "i long, x array<double>")
    right = frame(spark, [(j, p.tolist()) for j, p in enumerate(y)], "j long, y array<double>")
    got = {(r.i, r.j) for r in within(left, right, 1.5, widest(left, "x", 5)).collect()}
    want = {(i, j) for i, j in itertools.product(range(80), range(60)) if np.linalg.norm(x[i] - y[j]) <= 1.5}
    assert got == want


# ---- neighbours and silhouettes -------------------------------------------

@pytest.mark.parametrize("p", [1.0, 2.0, math.inf, 3.0])
@pytest.mark.parametrize("broadcast_rows,query_rows", [(100_000, 10), (10, 1000), (10, 10)])
def test_nearest_neighbours(spark, p, broadcast_rows, query_rows):
    refs, queries = random_points(300, 3, 3, copies=100), random_points(90, 3, 4, copies=30)
    queries[0] = refs[0]
    r = frame(spark, [(i, v.tolist(), float(i)) for i, v in enumerate(refs)], "rid long, x array<double>, label double")
    q = frame(spark, [(i, v.tolist()) for i, v in enumerate(queries)], "qid long, x array<double>")
    found = nearest_neighbours(q, r, 4, p, broadcast_rows=broadcast_rows, query_rows=query_rows, pivots=12, chunk_rows=16).collect()
    got = {}
    for row in sorted(found, key=lambda t: (t.qid, t.distance, t.rid)):
        got.setdefault(row.qid, []).append(row.rid)
        assert row.label == row.rid
    for i, v in enumerate(queries):
        d = np.abs(refs - v)
        d = d.max(axis=1) if math.isinf(p) else (d**p).sum(axis=1) ** (1 / p)
        d = np.round(d, 12)
        want = sorted(range(300), key=lambda j: (d[j], j))[:4]
        assert [d[j] for j in got[i]] == [d[j] for j in want] and len(set(got[i])) == 4


@pytest.mark.parametrize("p", [1.0, 2.0, math.inf])
def test_pivot_tree(p):
    """Points are put into the cell of their nearest pivot, and no member within reach is missed."""
    x = random_points(2_000, 3, 8, copies=300)
    tree = PivotTree(x[::15], p)
    leaf, d = tree.assign(x)
    assert d == pytest.approx(distances(x, tree.leaves, p).min(axis=1))
    tree.measured({i: d[leaf == i].max() for i in np.unique(leaf)})
    asked = x[:200] + 0.01
    own, home = tree.assign(asked)
    row, cell = tree.reached(asked, np.full(200, 0.4), own, home)
    near = distances(asked, x, p) <= 0.4
    visited = np.zeros((200, len(tree.leaves)), bool)
    visited[row, cell] = True
    visited[np.arange(200), own] = True
    assert visited[np.nonzero(near)[0], leaf[np.nonzero(near)[1]]].all()
    assert visited.mean() < 0.5


@pytest.mark.parametrize("far", [0.0, 1e4])
def test_screen_is_exact(far):
    """Estimates by a matrix product decide nothing: nearest and links are those of all distances, to the last bit and with ties."""
    b, a = random_points(3_000, 12, 21, copies=40) + far, random_points(200, 12, 22) + far
    a[:20] = b[30:50]
    fast = Screen(b)
    d = distances(a, b)
    best, near = fast.nearest(a, 7)
    assert (best == smallest(d, 7)).all() and (near == np.take_along_axis(d, best, axis=1)).all()
    eps = float(np.sort(d[3])[50])
    i, j = fast.within(a, eps)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(d <= eps))))
    assert product_distances(a, b) == pytest.approx(d, rel=1e-9, abs=0)


def test_wide_neighbours_meet_in_few_blocks(spark, monkeypatch):
    """Where every ball reaches every cell, queries are not sent to one cell after the other."""
    import tablewright.operators.neighbours as module

    refs, queries = random_points(400, 16, 23), random_points(120, 16, 24)
    r = frame(spark, [(i, v.tolist()) for i, v in enumerate(refs)], "rid long, x array<double>")
    q = frame(spark, [(i, v.tolist()) for i, v in enumerate(queries)], "qid long, x array<double>")
    met = []
    inner = module.meet_in_chunks
    monkeypatch.setattr(module, "meet_in_chunks", lambda left, right, cells, *a: met.append((left.count(), len(cells))) or inner(left, right, cells, *a))
    got = {}
    for row in nearest_neighbours(q, r, 4, broadcast_rows=10, query_rows=10, pivots=40).orderBy("qid", "distance", "rid").collect():
        got.setdefault(row.qid, []).append(row.rid)
    assert got == {i: v.tolist() for i, v in enumerate(smallest(distances(queries, refs), 4))}
    assert met == [(120, 1)]


def brute_silhouette(x, c):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    s = []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            s.append(0.0)
            continue
        a, b = d[i, own].mean(), min(d[i, c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(s))


@pytest.mark.parametrize("broadcast_rows", [100_000, 10])
def test_silhouette(spark, broadcast_rows):
    x = random_points(120, 3, 5, copies=40)
    c = np.arange(120) % 4
    c[7] = 9
    df = frame(spark, [(p.tolist(), int(k)) for p, k in zip(x, c)], "features array<double>, c long")
    got = silhouette(df, "features", "c", broadcast_rows=broadcast_rows, block_rows=20)
    assert got == pytest.approx(brute_silhouette(x, c), abs=1e-9)


def test_wide_silhouette(spark):
    x = random_points(150, 20, 25, copies=30)
    c = np.arange(150) % 5
    df = frame(spark, [(p.tolist(), int(k)) for p, k in zip(x, c)], "features array<double>, c long")
    for broadcast_rows in (100_000, 10):
        assert silhouette(df, "features", "c", broadcast_rows=broadcast_rows, block_rows=40) == pytest.approx(brute_silhouette(x, c), abs=1e-9)


@pytest.mark.parametrize("width,clusters", [(1, 3), (2, 3), (2, 40), (3, 2)])
def test_silhouette_of_many_narrow_points(spark, monkeypatch, width, clusters):
    """Far points act by grids; no step compares all points with all."""
    import tablewright.operators.distance_sums as sums
    import tablewright.operators.silhouette as module

    def refused(a, b):
        raise AssertionError("all pairs")

    monkeypatch.setattr(module, "product_distances", refused)
    monkeypatch.setattr(module, "mean_score", lambda *a: sums.mean_score(*a, block_points=1_500, leaf_points=300))
    rng = np.random.default_rng(11)
    x = rng.random((4_000, width)) + 3 * rng.integers(0, 2, (4_000, 1))
    x[:500] = x[500:1_000]
    x[-1] = 1e4
    c = rng.integers(0, clusters, 4_000) if clusters > 3 else (4 * x[:, 0]).astype(int) % clusters
    c[7] = 99
    df = frame(spark, [(p.tolist(), int(k)) for p, k in zip(x, c)], "features array<double>, c long")
    d = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(width)))
    names, code = np.unique(c, return_inverse=True)
    size, total = np.bincount(code), d @ np.eye(len(names))[code]
    at = np.arange(len(x))
    own, means = total[at, code] / np.maximum(size[code] - 1, 1), total / size
    means[at, code] = np.inf
    other = means.min(axis=1)
    expected = np.where(size[code] > 1, (other - own) / np.maximum(own, other), 0.0).mean()
    assert module.silhouette(df, "features", "c", broadcast_rows=10) == pytest.approx(expected, abs=1e-10)


def test_grids_leave_few_points_to_meet():
    """Of 40,000 points in a square a leaf of 300 meets few one by one, and sums keep nine digits."""
    from tablewright.operators import distance_sums as sums

    rng = np.random.default_rng(5)
    x = rng.random((40_000, 2))
    order, nodes = sums._split(x, 300)
    x = x[order]
    assert (sums._split(x, 300)[0] == np.arange(len(x))).all()
    rows = []
    for i, (start, stop, left, right) in enumerate(nodes):
        own = x[start:stop]
        low, high = own.min(axis=0), own.max(axis=0)
        grid = sums._weights(own, np.ones(len(own)), low, high).tobytes()
        rows.append((0, i, start, stop, left, right, low, high, [0], grid))
    tree = sums._Tree(pd.DataFrame(rows, columns=["b", "node", "start", "stop", "left", "right", "lo", "hi", "c", "m"]), 2)
    for part, far, near in list(sums._views(x, tree, 300))[::40]:
        met = np.concatenate([np.arange(tree.start[i], tree.stop[i]) for i in near])
        assert len(met) < 16_000
        got = tree.grid_sums(x[part], far, 1)
        sums._pair_sums(x[part], x[met], np.zeros(len(met), int), np.ones(len(met)), got)
        exact = np.sqrt(((x[part][:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1)
        assert got[:, 0] == pytest.approx(exact, rel=1e-9)


def test_silhouette_needs_two_clusters(spark):
    df = frame(spark, [([1.0], 0), ([2.0], 0)], "features array<double>, c long")
    assert silhouette(df, "features", "c") is None


# ---- metrics, text, charts ------------------------------------------------

def test_scores_with_unseen_class(spark):
    df = frame(spark, [(0.0, 0.0), (1.0, 2.0), (1.0, 1.0), (2.0, 0.0)], "label double, prediction double")
    row = metrics.classification_metrics(df).first()
    assert (row.accuracy, row.recall) == (0.5, 0.5)
    assert row.precision == pytest.approx((0.5 * 1 + 1.0 * 2 + 0.0) / 4)


def test_reply_parsing(spark):
    df = frame(spark, [("ok {\"a\": 1} then {\"b\": 2}",), ("x {\"a\": 3} y",), ("none",), ("{bad",), ("{\"b\": 1}",)], "t string")
    got = [r[0] for r in df.select(json_object(F.col("t"), "a int, b int", ["a"])["a"]).collect()]
    assert got == [None, 3, None, None, None]
    fenced = frame(spark, [("```json\n{\"a\": 1}\n```",), ("plain ",), ("```json {}",)], "t string")
    assert [r[0] for r in fenced.select(strip_fence(F.col("t"))).collect()] == ['{"a": 1}', "plain", "{}"]


def test_chart_limit(spark):
    df = spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b"))
    assert charts.chart_data(df, "a", "b", limit=5).count() == 5


# ---- features -------------------------------------------------------------

def test_routing():
    spec = DatasetSpec(types={"a": "float", "b": "str", "c": "date_time", "d": "bool", "y": "int"}, target_column="y")
    assert route_columns(spec) == (["a"], ["b"], ["c"])
    assert route_columns(DatasetSpec(types=spec.types, compat=True))[2] == []


def feature_rows(model, df):
    return sorted(tuple(np.round(r.features.toArray(), 9)) for r in model.transform(df).collect())


def test_features_save_load_unseen_and_wide(spark, tmp_path):
    df = frame(spark, [(1.0, "it's", "2020-01-02 03:04:05"), (2.0, "b\\c", "10:11:12"), (None, None, "bad"), (9.0, "b\\c", None)], "n double, c string, t string")
    spec = DatasetSpec(types={"n": "float", "c": "category", "t": "time"})
    model = features.fit_features(df, spec)
    assert model.names == ["n", "c=b\\c", "c=it's", *[f"t_{p}" for p in features.DATETIME_PARTS]]
    rows = feature_rows(model, df)
    assert rows[0][3:] == (2, 1, 2020, 3, 4, 5) and rows[1][3:] in ((12 - 11, 1, 1900, 10, 11, 12), (1, 1, 1900, 0, 0, 0))
    model.save(str(tmp_path / "m"))
    again = features.FeatureModel.load(spark, str(tmp_path / "m"))
    assert feature_rows(again, df) == rows
    unseen = frame(spark, [(1.0, "zzz", None)], "n double, c string, t string")
    assert feature_rows(model, unseen)[0][1:3] == (0.0, 0.0)
    wide = features.fit_features(df, spec, wide_categories=1)
    assert wide.wide == ["c"] and feature_rows(wide, df) == rows
    assert feature_rows(wide, unseen)[0][1:3] == (0.0, 0.0)
    wide.save(str(tmp_path / "w"))
    assert feature_rows(features.FeatureModel.load(spark, str(tmp_path / "w")), df) == rows


def test_set_slots_of_a_very_wide_vector(spark):
    """A vector of ten million slots is listed by what it holds; made dense, these rows would need 8 GB."""
    from pyspark.ml.linalg import SparseVector, Vectors

    wide = [(i, SparseVector(10_000_000, [0, 5 + i, 9_999_999], [2.0, 1.0, 0.0])) for i in range(100)]
    df = spark.createDataFrame([*wide, (100, Vectors.dense([0.0, 3.0]))], ["id", "features"])
    got = sorted(tuple(r) for r in features.FeatureModel.set_slots(df, "id").collect())
    assert got == sorted([(i, p, v) for i in range(100) for p, v in ((0, 2.0), (5 + i, 1.0))] + [(100, 1, 3.0)])


def test_pca_is_centred(spark):
    df = frame(spark, [(float(i), 2.0 * i + (i % 3), float(i % 2), i) for i in range(60)], "a double, b double, c double, id long")
    spec = DatasetSpec(types={"a": "float", "b": "float", "c": "float"}, dimensionality_reduction=True, row_key=("id",))
    train, test, model = build_features(df, spec)
    x = np.array([r.features.toArray() for r in train.unionByName(test).collect()])
    assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and x.shape == (60, len(model.names)) and len(model.names) == 2


def test_fit_on_train_only(spark):
    df = spark.range(200).select("id", F.col("id").cast("double").alias("v"))
    spec = DatasetSpec(types={"v": "float"}, row_key=("id",))
    train, _, _ = build_features(df, spec, fit_on="train")
    assert abs(np.mean([r.features[0] for r in train.collect()])) < 1e-9


def test_owned_tables_are_deleted(spark):
    import os

    from tablewright.runtime import cut, owned_tables

    with owned_tables(spark):
        inner = cut(spark.range(5), "owned")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert inner.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_oversample_of_a_very_rare_class(spark, monkeypatch):
    from tablewright.operators import cleaning

    monkeypatch.setattr(cleaning, "COPIES_TOGETHER", 10)
    df = spark.range(301).selectExpr("id", "case when id = 0 then 'rare' else 'usual' end as label")
    out = cleaning.oversample(df, "label", ["id"]).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("c")).collect()
    assert {r["label"]: (r["n"], r["c"]) for r in out} == {"rare": (300, 300), "usual": (300, 1)}


def test_unnamed_columns_and_quoted_breaks(spark, tmp_path):
    from tablewright.operators.cleaning import drop_unnamed
    from tablewright.sources.tables import read_csv

    (tmp_path / "t.csv").write_text('_c0,,b\n1,2,"x\ny"\n3,4,z\n')
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["_c0", "Unnamed: 1", "b"] and drop_unnamed(df).columns == ["_c0", "b"]
    assert [r["b"] for r in df.orderBy("_c0").collect()] == ["x\ny", "z"]


def test_metrics_and_depths_are_checked(spark):
    from tablewright.learners.catalogue import train

    df = spark.range(20).selectExpr("array(cast(id as double)) as features", "cast(id > 9 as double) as label")
    with pytest.raises(ValueError):
        train("knn_classifier", df, metric="hamming")
    with pytest.raises(ValueError):
        train("decision_tree", df, max_depth=45)


# ---- csv records over byte ranges ------------------------------------------

CSV_OPTIONS = {"multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def random_csv(folder, rng, end):
    import csv
    import io

    rows = []
    for f in range(2):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", 'a,"b', "text\nx", "d"])
        cell = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", '""', "x\ny"]) for _ in range(rng.randint(1, 12)))
        for i in range(70):
            if rng.random() < 0.1:
                out.write(end)  # an empty line
            elif rng.random() < 0.2:
                out.write(f'{f * 1000 + i},5" pipe,a"b"c,x{end}')  # quotes inside cells without quotes
                rows.append((str(f * 1000 + i), '5" pipe', 'a"b"c', "x"))
            else:
                row = (str(f * 1000 + i), cell(), "\n" * rng.randint(1, 90) if rng.random() < 0.1 else cell(), cell())
                writer.writerow(row)
                rows.append(row)
        (folder / f"{f}.csv").write_text(out.getvalue(), newline="")
    return rows


@pytest.mark.parametrize("size", ["150", "3000"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_records_over_ranges(spark, tmp_path, size, end):
    import random

    wanted = random_csv(tmp_path, random.Random(size), end)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = tables.csv_records(spark, str(tmp_path))
        ranges = records.select("file", "start").distinct().count()
        got = sorted(tuple(r) for r in tables._parsed(records.where("start > 0 or n > 0"), 4, CSV_OPTIONS).collect())
        typed = tables.read_csv(spark, str(tmp_path))
        assert typed.columns == ["id", 'a,"b', "text\nx", "d"] and typed.count() == len(wanted)
        if end == "\n":
            multi = spark.read.options(header=True, **CSV_OPTIONS).csv(str(tmp_path))
            assert got == sorted(tuple(r) for r in multi.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(wanted)
    assert ranges > 20 if size == "150" else ranges >= 2


def test_csv_odd_files(spark, tmp_path):
    """An open quote at the end, a header alone, nothing at all."""
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "open.csv"), infer=False).collect()] == [("1", "x\ny")]
    (tmp_path / "head.csv").write_text("a,b\n")
    assert tables.read_csv(spark, str(tmp_path / "head.csv"), infer=False).count() == 0
    (tmp_path / "none.csv").write_text("")
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), infer=False).count() == 0


def test_csv_one_file_has_bounded_writers(spark, sf, tmp_path, monkeypatch):
    """The writers of large files grow in number with the bytes, and every row is read back."""
    from tablewright.catalogue import cleaning as catalogue

    wanted = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(catalogue, "FILE_BYTES", wanted.agg(F.sum(F.octet_length("text"))).first()[0] // 3)
    wanted.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    inner = catalogue.tables.write_csv
    monkeypatch.setattr(catalogue.tables, "write_csv", lambda df, path: paths.append(path) or inner(df, path))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # one task for each of the 8 parts
    try:
        got = catalogue.QUERIES["csv_one_file"](spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert len(spark.read.text(paths[0]).inputFiles()) >= 3
    assert sorted(got.select("doc_id").toPandas()["doc_id"]) == sorted(wanted.select("doc_id").toPandas()["doc_id"])


def test_stream_clean_mean_in_a_zone_with_summer_time(spark, tmp_path):
    """Events across a change of the clocks: which of them are late must not depend on the session's zone."""
    from compare import differences
    from __spark_entry__ import oracle_sql, queries

    rows = spark.range(2_000).selectExpr("id as event_id", "timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, id) as ts",
                                         "id % 500 as user_id", "'view' as event_type", "id * 1.25e0 as value", "'' as props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert differences(db, queries()["stream_clean_mean"](spark, str(tmp_path)), oracle_sql()["stream_clean_mean"]) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
