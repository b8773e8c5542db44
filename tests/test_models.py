"""Trainers against closed forms and brute force; clusterers against small exact answers."""

import importlib
import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.clustering.density import dbscan
from tablewright.clustering.hierarchy import agglomerative, birch, cut_tree, merge_tree
from tablewright.clustering.linkage import separate_parts, single_linkage, spanning_tree
from tablewright.clustering import bandwidth, centres
from tablewright.clustering.bandwidth import estimate_bandwidth
from tablewright.functions.blocks import distances
from tablewright.clustering.modes import mean_shift
from tablewright.clustering.spectral import spectral
from tablewright.clustering.wide_density import label_points
from tablewright.learners import margins
from tablewright.learners.base import load_model, save_model
from tablewright.learners.catalogue import train
from tablewright.plans.train import train_job, train_model
from tablewright.runtime import cut
from tablewright.sources.registry import model_metrics, read_registry

RNG = np.random.default_rng(11)
X = RNG.normal(size=(200, 3)) * [1.0, 2.0, 0.5]
Y = X @ [1.5, -2.0, 0.0] + 0.7 + RNG.normal(size=200) * 0.3
C = (X[:, 0] + 0.5 * X[:, 1] > 0).astype(float)


def table(spark, x, y):
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"f{i} double" for i in range(x.shape[1])) + ", label double")
    return VectorAssembler(inputCols=df.columns[:-1], outputCol="features").transform(df).select("features", "label")


def coordinate_descent(x, y, alpha, ratio, steps=3000):
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w


@pytest.mark.parametrize("name,hyper,alpha,ratio", [
    ("linear_regression", {}, 0.0, 0.0), ("ridge", {"alpha": 40.0}, 40.0 / 200, 0.0), ("lasso", {"alpha": 0.3}, 0.3, 1.0),
    ("elastic_net", {"alpha": 0.4, "l1_ratio": 0.3}, 0.4, 0.3)])
def test_linear_family(spark, name, hyper, alpha, ratio):
    fitted = train(name, table(spark, X, Y), **hyper, n_jobs=4)
    assert np.allclose(fitted.model.coefficients.toArray(), coordinate_descent(X, Y, alpha, ratio), atol=1e-4)
    assert fitted.ignored == ["n_jobs"] and fitted.metrics["train_r2"] <= 1


def test_positive_coefficients(spark):
    model = train("linear_regression", table(spark, X, Y), positive=True).model
    w = np.array(model.coefficients)
    assert (w >= 0).all() and w[1] == 0
    one = np.column_stack([np.ones(200), X[:, [0, 2]]])
    want = np.linalg.lstsq(one, Y, rcond=None)[0][1:]
    assert np.allclose(w[[0, 2]], np.maximum(want, 0), atol=0.05)


def test_logistic_matches_newton(spark):
    c = 0.5
    model = train("logistic_regression", table(spark, X, C), C=c, tol=1e-10, max_iter=500).model
    a, t = np.column_stack([X, np.ones(200)]), np.zeros(4)
    penalty = np.array([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ t))
        t -= np.linalg.solve(c * a.T @ (a * (p * (1 - p))[:, None]) + np.diag(penalty), c * a.T @ (p - C) + penalty * t)
    assert np.allclose(np.append(model.coefficients.toArray(), model.intercept), t, atol=1e-4)


def test_support_vectors(spark):
    assert train("svc", table(spark, X, C), kernel="linear", C=10.0).metrics["train_accuracy"] > 0.95
    assert train("svc", table(spark, X, C), kernel="poly", degree=2, coef0=1.0).metrics["train_accuracy"] > 0.9
    ring = (X[:, 0] ** 2 + X[:, 1] ** 2 < 2).astype(float)
    assert train("svc", table(spark, X, ring), kernel="rbf", C=10.0).metrics["train_accuracy"] > 0.9
    fitted = train("svr", table(spark, X, Y), kernel="linear", C=10.0, epsilon=0.1)
    assert np.allclose(fitted.model.inner.coefficients, [1.5, -2.0, 0.0], atol=0.15)
    with pytest.raises(ValueError):
        train("svc", table(spark, X, C), kernel="sigmoid")


def test_svr_passes_read_equal_rows_once(spark, monkeypatch):
    """Equal rows act as one row with a weight, and the fit is that of all rows."""
    read, loss_pass = [], margins._loss_pass
    monkeypatch.setattr(margins, "_loss_pass", lambda rows, *more: read.append(rows.count()) or loss_pass(rows, *more))
    x = np.repeat(np.arange(10.0), 30)[:, None]
    model = train("svr", table(spark, x, 2 * x[:, 0] + np.arange(300) % 2), kernel="linear", C=10.0, epsilon=0.1).model
    assert set(read) == {20}
    assert model.inner.coefficients[0] == pytest.approx(2.0, abs=0.05)


def test_kmeans_fits_equal_rows_once(spark, monkeypatch):
    read, fit = [], centres.KMeans.fit
    monkeypatch.setattr(centres.KMeans, "fit", lambda self, df: read.append(df.count()) or fit(self, df))
    x = np.repeat([0.0, 1.0, 100.0, 103.0], [40, 20, 10, 30])[:, None]
    model, progress = centres.kmeans(table(spark, x, x[:, 0]), {"n_clusters": 2})
    assert read == [4]
    assert sorted(c[0] for c in model.clusterCenters()) == pytest.approx([1 / 3, 102.25])
    assert progress[0] == pytest.approx(60 * (1 / 3) * (2 / 3) + 40 * 9 * 3 / 16)


def test_adaboost_learns(spark):
    two = ((X[:, 0] > 0) & (X[:, 1] > 0)).astype(float)
    fitted = train("ada_boost_classifier", table(spark, X, two), n_estimators=7)
    assert fitted.metrics["train_accuracy"] > 0.9 and len(fitted.progress) == len(fitted.model.alphas)
    # first round: the best stump's weighted error decides its vote
    err = fitted.progress[0]
    assert fitted.model.alphas[0] == pytest.approx(math.log((1 - err) / err))
    assert train("ada_boost_regressor", table(spark, X, Y), n_estimators=6).metrics["train_r2"] > 0.8


def test_more_than_two_classes(spark):
    three = np.digitize(X[:, 1], [-1, 1]).astype(float)
    for name, hyper in (("logistic_regression", {}), ("gradient_boosting", {"n_estimators": 3}), ("svc", {"kernel": "linear"}),
                        ("mlp", {"max_iter": 60, "hidden_layer_sizes": (8,)}), ("random_forest", {"n_estimators": 5, "class_weight": "balanced"})):
        assert train(name, table(spark, X, three), **hyper).metrics["train_accuracy"] > 0.7


@pytest.mark.parametrize("name,hyper", [
    ("linear_regression", {}), ("linear_regression", {"positive": True}), ("ada_boost_classifier", {"n_estimators": 2}), ("gaussian_nb", {}),
    ("knn_classifier", {}), ("svc", {"kernel": "rbf", "random_features": 16}), ("kmeans", {"n_clusters": 2}), ("minibatch_kmeans", {"n_clusters": 2, "max_iter": 2})])
def test_save_and_load(spark, tmp_path, name, hyper):
    df = table(spark, X, C)
    model = train(name, df, **hyper).model
    again = load_model(spark, save_model(model, str(tmp_path / "m")))
    get = lambda m: sorted((tuple(r.features), r.prediction) for r in m.transform(df).collect())
    assert get(again) == get(model)


@pytest.mark.parametrize("name", ["gaussian_nb", "multinomial_nb", "complement_nb", "bernoulli_nb", "categorical_nb"])
def test_bayes_options(spark, name):
    counts = RNG.integers(0, 4, (120, 3)).astype(float)
    label = (counts[:, 0] > 1).astype(float)
    hyper = {"priors": [0.2, 0.8]} if name == "gaussian_nb" else {"class_prior": [0.2, 0.8], "alpha": 0.5}
    extra = {"complement_nb": {"norm": True}, "categorical_nb": {"min_categories": 6}, "bernoulli_nb": {"binarize": 1.0}}.get(name, {})
    fitted = train(name, table(spark, counts, label), **hyper, **extra)
    assert fitted.metrics["train_accuracy"] > 0.5 and fitted.ignored == []
    flat = train(name, table(spark, counts, label), **({} if name == "gaussian_nb" else {"fit_prior": False}))
    assert flat.metrics["train_accuracy"] > 0.5


def test_knn_metrics(spark):
    for metric in ("manhattan", "chebyshev", "cosine"):
        assert train("knn_classifier", table(spark, X, C), metric=metric, n_neighbors=3).metrics["train_accuracy"] > 0.8
    exact = train("knn_regressor", table(spark, X, Y), weights="distance", n_neighbors=3)
    assert exact.metrics["train_mse"] == pytest.approx(0, abs=1e-12)


# ---- clustering -----------------------------------------------------------

def brute_dbscan(x, eps, m, p=2.0):
    d = np.abs(x[:, None] - x[None])
    d = d.max(axis=2) if math.isinf(p) else (d**p).sum(axis=2) ** (1 / p)
    near = d <= eps
    core = near.sum(axis=1) >= m
    label, k = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = k
                    stack += [t for t in np.flatnonzero(near[j] & core) if label[t] < 0]
            k += 1
    out = label.copy()
    for i in np.flatnonzero(~core):
        found = label[near[i] & core]
        out[i] = found.min() if len(found) else -1
    return out, core


@pytest.mark.parametrize("d,eps,m,metric", [(1, 0.05, 4, "euclidean"), (2, 0.3, 6, "manhattan"), (5, 1.1, 4, "euclidean")])
def test_dbscan_matches_brute_force(spark, d, eps, m, metric):
    rng = np.random.default_rng(d)
    x = np.round(np.concatenate([rng.normal(0, 0.5, (130, d)), rng.normal(2, 0.3, (90, d)), rng.uniform(-3, 4, (80, d))]), 3)
    x[200:250] = x[0]
    p = {"euclidean": 2.0, "manhattan": 1.0, "chebyshev": math.inf}[metric]
    want, core = brute_dbscan(x, eps, m, p)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    rows = {r.id: r for r in dbscan(df, "id", "features", eps=eps, min_samples=m, metric=metric).collect()}
    assert [rows[i].core for i in range(len(x))] == core.tolist()
    assert [rows[i].cluster for i in range(len(x))] == want.tolist()


@pytest.mark.parametrize("chunk_rows, p", [(8_192, 2.0), (25, 1.0)])
def test_dbscan_of_many_columns(spark, chunk_rows, p):
    """Cells of pivots, whole or in chunks, one of them with a third of all points."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.3, (200, 12)), rng.normal(1.2, 0.25, (120, 12)), rng.uniform(-2, 3, (60, 12))])
    w = rng.integers(1, 3, len(x))
    eps = 1.1 if p == 2 else 3.2
    points = spark.createDataFrame([(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, w))], "pid long, x array<double>, w long")
    want, core = brute_dbscan(np.repeat(x, w, axis=0), eps, 5, p)
    first = np.concatenate([[0], np.cumsum(w)[:-1]])
    rows = {r.pid: r for r in label_points(points, eps, 5, p, pivots=14, chunk_rows=chunk_rows).collect()}
    assert [rows[i].core for i in range(len(x))] == core[first].tolist() and core.any() and not core.all()
    assert [rows[i].cluster for i in range(len(x))] == want[first].tolist()


@pytest.mark.parametrize("block_rows", [32_768, 50])
def test_dbscan_of_many_columns_by_blocks(spark, monkeypatch, block_rows):
    """Where every ball reaches most cells, no point is sent to one cell after the other."""
    import tablewright.clustering.wide_density as module

    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(0, 0.3, (200, 12)), rng.normal(0.9, 0.25, (120, 12)), rng.uniform(-2, 3, (60, 12))])
    points = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(x)], "pid long, x array<double>, w long")
    monkeypatch.setattr(module._Cells.__init__, "__defaults__", (block_rows,))
    assert module._Cells(points, 1.1, 2.0, 40, 8_192).asking.count() == len(x)
    want, core = brute_dbscan(x, 1.1, 5, 2.0)
    rows = {r.pid: r for r in label_points(points, 1.1, 5, 2.0, pivots=40).collect()}
    assert [rows[i].core for i in range(len(x))] == core.tolist() and core.any() and not core.all()
    assert [rows[i].cluster for i in range(len(x))] == want.tolist()


def brute_linkage(x, linkage, k):
    groups = [[i] for i in range(len(x))]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)

    def gap(a, b):
        if linkage == "ward":
            ca, cb = x[a].mean(0), x[b].mean(0)
            return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(ca - cb)
        block = d[np.ix_(a, b)]
        return {"average": block.mean(), "complete": block.max(), "single": block.min()}[linkage]

    while len(groups) > k:
        pairs = [(gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def partition(labels, key="cluster"):
    out = {}
    for r in labels.collect():
        out.setdefault(r[key], set()).add(r.id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_agglomerative_matches_brute_force(spark, linkage):
    x = np.random.default_rng(5).normal(size=(40, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    assert partition(agglomerative(df, "id", "features", n_clusters=4, linkage=linkage)) == brute_linkage(x, linkage, 4)


def test_agglomerative_compares_distinct_points_only(spark, monkeypatch):
    """Equal rows take the cluster of their point; centres are compared with every point once."""
    from tablewright.clustering import hierarchy

    seen, inner = [], hierarchy.assign
    monkeypatch.setattr(hierarchy, "assign", lambda df, *a: seen.append(df.count()) or inner(df, *a))
    x = np.random.default_rng(5).normal(size=(40, 2))
    df = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(400)], "id long, features array<double>")
    for linkage in ("ward", "average", "complete"):
        copies = partition(agglomerative(df, "id", "features", n_clusters=4, linkage=linkage))
        tree = cut_tree(40, merge_tree(x, np.full(40, 10.0), linkage), 4, None)
        assert copies == {frozenset(i for i in range(400) if tree[i % 40] == k) for k in set(tree.tolist())}
    assert seen == [40, 40, 40]


def test_single_linkage_by_threshold(spark):
    x = np.random.default_rng(6).uniform(0, 5, (60, 2))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = partition(agglomerative(df, "id", "features", n_clusters=None, linkage="single", distance_threshold=0.6))
    merges = merge_tree(x, np.ones(60), "single")
    assert len(got) == 60 - sum(1 for m in merges if m[0] < 0.6)


def points_frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pid long, x array<double>").repartition(4)


def plain_tree(x):
    """Lengths of a minimum spanning tree, by adding the nearest point again and again."""
    near, out = np.linalg.norm(x - x[0], axis=1), []
    inside = np.zeros(len(x), bool)
    inside[0] = True
    for _ in range(len(x) - 1):
        i = int(np.where(inside, np.inf, near).argmin())
        out.append(near[i])
        inside[i] = True
        near = np.minimum(near, np.linalg.norm(x - x[i], axis=1))
    return np.sort(out)


@pytest.mark.parametrize("kind, boxed", [("uniform", 1_000), ("clumps", 1_000), ("clumps", 0), ("grid", 1_000)])
def test_spanning_tree(spark, kind, boxed):
    """The tree is as short as a plain one, whether lists of neighbours or boxes find its long edges."""
    rng = np.random.default_rng(11)
    x = {"uniform": rng.random((400, 3)), "grid": np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), axis=2).reshape(-1, 2),
         "clumps": np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (9, 1), (4, 7), (20, 20), (20, 24))])}[kind]
    tree = spanning_tree(points_frame(spark, x), neighbours=4, boxed_parts=boxed).toPandas()
    assert len(tree) == len(x) - 1
    assert np.sort(tree["d"]) == pytest.approx(plain_tree(x), abs=1e-9)


def test_single_linkage_of_a_thousand_points(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(c, 0.5, (250, 2)) for c in ((0, 0), (6, 0), (0, 9), (30, 30))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    labels = cut_tree(len(x), merge_tree(x, np.ones(len(x)), "single"), 7, None)
    want = {frozenset(np.flatnonzero(labels == k).tolist()) for k in range(7)}
    assert partition(agglomerative(df, "id", "features", n_clusters=7, linkage="single")) == want


def test_separate_parts(spark, p=2.0):
    """Parts that two grids agree on are those of single linkage; no tree is grown inside them."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.uniform(0, 1, (250, 2)) + c for c in ((0, 0), (9, 0), (0, 12), (90, 90), (90, 102))])
    pts = points_frame(spark, x)
    for k, want in ((2, 2), (3, 5), (5, 5)):
        found = separate_parts(pts, k, p).toPandas()
        assert found["c"].nunique() == want and (found["c"] == found["pid"] // 250 // (3 if want == 2 else 1) * (750 if want == 2 else 250)).all()
    labels = cut_tree(len(x), merge_tree(x, np.ones(len(x)), "single", p), 3, None)
    got = single_linkage(pts, 3, p).toPandas().groupby("cluster")["pid"].agg(frozenset)
    assert set(got) == {frozenset(np.flatnonzero(labels == c).tolist()) for c in range(3)}
    even = np.stack(np.meshgrid(np.arange(12.0), np.arange(12.0)), axis=2).reshape(-1, 2)
    assert separate_parts(points_frame(spark, even), 2, p, 20) is None


def test_single_linkage_of_rings_grows_no_tree(spark, monkeypatch):
    """All points of one ring are equally far from a point of the other, so boxes cannot settle the edge between them."""
    monkeypatch.setattr("tablewright.clustering.linkage.spanning_tree", None)
    x = ring_points(6_000, 4, 0.0)
    found = single_linkage(points_frame(spark, x), 2).toPandas().sort_values("pid")
    assert (found["cluster"] == found["pid"] % 2).all()


def blobs(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 3, 2)) for c in ((0, 0), (6, 6), (0, 8))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    return df, {frozenset(range(k * n // 3, (k + 1) * n // 3)) for k in range(3)}


def test_summaries_and_landmarks_recover_blobs(spark):
    df, want = blobs(spark)
    assert partition(agglomerative(df, "id", "features", n_clusters=3, summaries=60)) == want
    assert partition(birch(df, "id", "features", threshold=0.1, n_clusters=3)) == want
    assert partition(spectral(df, "id", "features", n_clusters=3, n_init=2, coarse=100)) == want
    assert partition(spectral(df, "id", "features", n_clusters=3, n_init=2, affinity="nearest_neighbors")) == want
    assert partition(mean_shift(df, "id", "features", bandwidth=2.0)) == want


def ring_points(n, seed, width=0.05):
    rng = np.random.default_rng(seed)
    t, wide = rng.uniform(0, 2 * np.pi, n), rng.normal(0, width, (n, 3))
    first = np.arange(n) % 2 == 0
    x = np.where(first[:, None], np.stack([np.cos(t), np.sin(t), 0 * t], axis=1), np.stack([1 + np.cos(t), 0 * t, np.sin(t)], axis=1))
    return x + wide


@pytest.mark.parametrize("coarse", [2_000, 150])
def test_spectral_rings_over_levels(spark, coarse):
    """A graph of one level and of several tells the same rings apart; equal rows act as one point."""
    x = ring_points(1_500, 4)
    x[:100] = x[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    want = {frozenset([*range(100), *range(100, 1500, 2)]), frozenset(range(101, 1500, 2))}
    assert partition(spectral(df, "id", "features", n_clusters=2, n_init=1, affinity="nearest_neighbors", coarse=coarse)) == want


def test_spectral_takes_few_levels(spark, monkeypatch):
    """Nodes without a centre beside them follow their neighbours, so that every graph has at most half the nodes of the one before."""
    module, sizes = importlib.import_module("tablewright.clustering.spectral"), []

    def counted(df, label="table"):
        out = cut(df, label)
        if label == "nodes":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(module, "cut", counted)
    x = [(i, [float(i % 3) * 100 + (i // 3) % 20, float(i // 60)]) for i in range(1_200)]
    df = spark.createDataFrame(x, "id long, features array<double>")
    labels = partition(spectral(df, "id", "features", n_clusters=3, n_init=1, affinity="nearest_neighbors", coarse=60))
    assert labels == {frozenset(range(j, 1_200, 3)) for j in range(3)}
    assert len(sizes) > 3 and all(b <= a / 2 for a, b in zip(sizes, sizes[1:]))


def test_spectral_block_step_is_a_matrix_product(spark):
    module = importlib.import_module("tablewright.clustering.spectral")
    rng, n = np.random.default_rng(5), 60
    a = np.triu(rng.uniform(size=(n, n)) * (rng.uniform(size=(n, n)) < 0.1), 1)
    a, loop = a + a.T, rng.uniform(size=n)
    a[:, 7] = a[7] = 0  # a node by itself
    rows = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))] + [(i, i, 0.0) for i in range(n)]
    edges = module._packed(spark.createDataFrame(rows + rows[:1], "u long, v long, a double"), 3, np.maximum)
    degree, v = a.sum(axis=1) + loop, rng.normal(size=(n, 2))
    vectors = spark.createDataFrame([(i, float(loop[i]), float(degree[i]), *map(float, v[i])) for i in range(n)], "id long, loop double, degree double, v0 double, v1 double")
    out = module._improved(vectors, edges, module._asked(edges), 2, 1).orderBy("id").toPandas()
    root = np.sqrt(degree)
    full = (v + (a + np.diag(loop)) / root[:, None] / root[None, :] @ v) / 2
    values, basis = np.linalg.eigh(full.T @ full)
    assert edges.count() == 8 and out["id"].tolist() == list(range(n))
    assert np.allclose(out[["v0", "v1"]].to_numpy(), full @ (basis / np.sqrt(values)), atol=1e-10)


def test_spectral_splits_what_hangs_together(spark):
    """Two clumps joined by a thin line fall apart in its middle; more parts than clusters go with the nearest."""
    rng = np.random.default_rng(7)
    line = np.stack([np.linspace(0.5, 3.5, 12), np.zeros(12)], axis=1)
    x = np.concatenate([rng.normal(0, 0.3, (300, 2)), rng.normal((4, 0), 0.3, (300, 2)), line])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    groups = partition(spectral(df, "id", "features", n_clusters=2, n_init=2, affinity="nearest_neighbors", n_neighbors=6, coarse=80))
    assert sorted(len(g & set(range(300))) for g in groups) == [0, 300] and sorted(len(g & set(range(300, 600))) for g in groups) == [0, 300]
    four = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (1, 0), (20, 0), (21, 0))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(four)], "id long, features array<double>")
    for coarse in (2_000, 50):
        assert partition(spectral(df, "id", "features", n_clusters=2, n_init=2, n_neighbors=5, coarse=coarse)) == {frozenset(range(120)), frozenset(range(120, 240))}


def test_mean_shift_outliers(spark):
    df, _ = blobs(spark, 300)
    far = df.union(spark.createDataFrame([(999, [50.0, 50.0])], df.schema))
    labels = {r.id: r.cluster for r in mean_shift(far, "id", "features", bandwidth=2.0, min_bin_freq=5, cluster_all=False).collect()}
    assert labels[999] == -1 and len(set(labels.values())) == 4
    assert partition(mean_shift(df, "id", "features")) is not None


def test_bandwidth_measures_shells_only(monkeypatch):
    """A block against itself: the k-th distances are exact, and few of all distances are measured for them."""
    x = np.random.default_rng(21).uniform(0, 1, (16_384, 2))
    x, k, seen = x[bandwidth._grouped(x)], 5_000, []
    guess, width = bandwidth._guesses(x, x, np.ones(len(x)), k)
    row = SimpleNamespace(x=x.tobytes(), w=np.ones(len(x)).tobytes(), r0=np.maximum(guess - width, 0), r1=guess + width, below=np.full(len(x), np.nan),
                          within=0.0, a=0, lo=None, hi=None, weight=0.0)
    monkeypatch.setattr(bandwidth, "KEPT", 10**9)
    own = bandwidth._Own(row, k, 64)
    monkeypatch.setattr(bandwidth, "distances", lambda a, b: seen.append(len(a) * len(b)) or distances(a, b))
    own.meet(bandwidth._Leaves(x, np.ones(len(x))))
    out = own.done()
    settled = out["r0"][0] == out["r1"][0]
    some = np.flatnonzero(settled)[::100]
    want = np.sort(distances(x[some], x), axis=1)[:, k - 1]
    assert settled.mean() > 0.9 and out["r0"][0][some] == pytest.approx(want, rel=1e-12)
    assert sum(seen) < 0.4 * len(x) ** 2


@pytest.mark.parametrize("repeats", [1, 600])
def test_bandwidth_counts_every_row(spark, repeats):
    x = np.random.default_rng(8).normal(size=(1200, 2))
    weights = [repeats] + [1] * 1199
    rows = np.repeat(x, weights, axis=0)
    d = np.sort(np.linalg.norm(rows[:, None] - rows[None], axis=2), axis=1)
    points = spark.createDataFrame([(r.tolist(), w) for r, w in zip(x, weights)], "x array<double>, w long")
    want = d[:, int(0.3 * len(rows)) - 1].mean()
    assert estimate_bandwidth(points, chunk_points=100 if repeats == 1 else 500) == pytest.approx(want, rel=1e-9)
    if repeats == 1:
        assert estimate_bandwidth(points, quantile=0.01, parts=7) == pytest.approx(d[:, 11].mean(), rel=1e-9)


def test_cluster_trainers_report(spark):
    df, _ = blobs(spark, 300)
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.select(F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))).select("features")
    for name, hyper in (("agglomerative", {"n_clusters": 3}), ("birch", {})):
        fitted = train(name, ready, n_jobs=1, **hyper)
        assert fitted.metrics["silhouette"] > 0.5 and fitted.ignored == ["n_jobs"]
    fitted = train("dbscan", ready, ready, eps=1.0, min_samples=5)
    assert fitted.metrics["train_clusters"] == 3 and fitted.metrics["test_clusters"] == 3 and fitted.progress == [3.0]
    fitted = train("kmeans", ready, ready, n_clusters=3)
    assert fitted.metrics["train_inertia"] == pytest.approx(fitted.metrics["test_inertia"])


# ---- jobs -----------------------------------------------------------------

def test_train_job_and_registry(spark, tmp_path):
    base = str(tmp_path / "reg")
    df = spark.range(300).selectExpr("id", "id % 7 as a", "case when id % 3 = 0 then null else concat('c', id % 4) end as b", "case when id % 7 > 3 then 'yes' else 'no' end as t")
    fitted = train_job(df, "decision_tree", "t", key=["id"], dataset_id="d1", registry=base)
    assert fitted.metrics["accuracy"] == 1.0
    train_job(df.drop("t"), "kmeans", hyperparameters={"n_clusters": 2}, dataset_id="d1", registry=base)
    for kind in ("logistic_regression", "random_forest", "mlp"):
        assert "accuracy" in train_job(df, kind, "t", key=["id"]).metrics
    rows = model_metrics(read_registry(spark, base), "d1").orderBy("name").collect()
    assert [(r.name, r.accuracy) for r in rows] == [("decision_tree", 1.0), ("kmeans", 0.0)]
    path = read_registry(spark, base).where("model_name = 'decision_tree'").first().path
    assert load_model(spark, path) is not None


def test_train_job_refusals(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        train_job(df, "perceptron", "id")
    with pytest.raises(ValueError):
        train_job(df, "decision_tree")
    with pytest.raises(ValueError):
        train_model("nothing", df, None)
    with pytest.raises(ValueError):
        train("nothing", df)
