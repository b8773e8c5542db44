"""Queries over what jobs store: versions of datasets, fitted transformers, models and cluster labels."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.catalogue.clusters import named
from tablewright.catalogue.inputs import BLOBS_SQL, LINE_KEY, LINES_SQL, blobs, lines, split_sql, table
from tablewright.learners.base import load_model, save_model
from tablewright.learners.catalogue import train
from tablewright.operators import features
from tablewright.operators.split import is_test
from tablewright.plans.clean import clean_all
from tablewright.plans.train import MODEL_TYPES, train_model
from tablewright.runtime import cut, new_folder
from tablewright.sources import registry, tables
from tablewright.spec import DatasetSpec

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


L = f"with d as (select *, {split_sql('k')} as test from ({LINES_SQL}))"
_KEYS = ", ".join(LINE_KEY)


@query("accepted_formats", "select page_id, regexp_extract(lower(rtrim(url, '/')), '\\.([^./]+)$', 1) in ('csv', 'parquet') as accepted from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", tables.accepted("url").alias("accepted"))


@query("best_version", "select o_orderkey, o_totalprice from orders where o_orderkey % 2 = 0")
def _(spark, sf):
    """Of a raw table, a finished version and a later one that is not finished, the finished one is read."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    base = new_folder(spark, "versions")
    raw = f"{base}/raw.parquet"
    orders.write.parquet(raw)
    tables.write_version(orders.where("o_orderkey % 2 = 0"), base, done=True)
    tables.write_version(orders.where("o_orderkey % 3 = 0"), base)
    return tables.load_best(spark, base, raw)


@query("raw_version", "select o_orderkey, o_totalprice from orders")
def _(spark, sf):
    """Without a finished version the raw dataset is read."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    base = new_folder(spark, "versions")
    raw = f"{base}/raw.parquet"
    orders.write.parquet(raw)
    tables.write_version(orders.where("o_orderkey % 3 = 0"), base)
    return tables.load_best(spark, base, raw)


@query("saved_pca", f"select {_KEYS}, round(abs(l_quantity - (select avg(l_quantity) from lineitem)), 6) as score from lineitem")
def _(spark, sf):
    """A fitted transformer that was saved and loaded: the only component of one column is its distance from the mean."""
    df = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity"))
    model, _ = features.fit_pca(df, k=1)
    loaded = load_model(spark, save_model(model, new_folder(spark, "transformer")))
    out = loaded.transform(df)
    found = [c for c in out.columns if c not in df.columns]
    return out.select(*LINE_KEY, F.round(F.abs(as_first(found[0] if found else "features")), 6).alias("score"))


def as_first(column: str):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))[0]


_FITTED = (", m as (select avg(qty) as mx, avg(y) as my, covar_pop(qty, y) / var_pop(qty) as slope from d where not test) "
           "select k, round(my + slope * (qty - mx), 4) as prediction from d, m where test")


# Two groups of quantities far apart.
_APART = "case when qty > 25 then qty + 1000 else qty end"


def _sides(spark, sf, label: str, feature: str = "qty", keep: tuple = ("k",)):
    df = lines(spark, sf).selectExpr("k", f"cast({feature} as double) as qty", f"cast({label} as double) as label")
    ready = VectorAssembler(inputCols=["qty"], outputCol="features").transform(df)
    marked = cut(ready.select(*keep, "features", "label", is_test("k").alias("test")), "sides")
    return marked.where("not test").drop("test"), marked.where("test").drop("test")


@query("registered_model", L + _FITTED)
def _(spark, sf):
    """Predictions of a model found through its registry row."""
    left, right = _sides(spark, sf, "y")
    base = new_folder(spark, "registry")
    registry.append_model(spark, base, "lines", train("linear_regression", left, right), "m1")
    path = registry.read_registry(spark, base).where("model_id = 'm1'").first().path
    return load_model(spark, path).transform(right).select("k", F.round("prediction", 4).alias("prediction"))


@query("registered_labels", f"select id, min(id) over (partition by truth) as cluster from ({BLOBS_SQL})")
def _(spark, sf):
    """Cluster labels stored with their registry row."""
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(blobs(spark, sf)).select("id", "features")
    base = new_folder(spark, "registry")
    registry.append_model(spark, base, "blobs", train("birch", df, threshold=0.5, n_clusters=3), "b1")
    return named(registry.read_labels(spark, base, "b1").select("id", "cluster"))


@query("model_switch", L + ", m as (select avg(qty) as mx, avg(y) as my, covar_pop(qty, y) / var_pop(qty) as slope, count(*) as n from d where not test), "
       f"g as (select sum(v) as spread from (select var_pop({_APART}) * count(*) as v from d where not test group by qty > 25)), "
       "e as (select avg((y - my - slope * (qty - mx)) ^ 2) as mse from d, m where test) "
       "select 'linear_regression' as model, 'mse' as metric, round(mse, 3) as value from e union all select 'kmeans', 'inertia', round(spread, 0) from g "
       "union all select 'pca', 'explained_variance', 1.0 union all select 'decision_tree', 'accuracy', 1.0 union all select 'perceptron', 'refused', 1.0")
def _(spark, sf):
    """Models by the name a request states, with its settings; an unknown name is refused."""
    left, right = _sides(spark, sf, "y", keep=())
    apart, _ = _sides(spark, sf, "y", _APART, ())
    classes, held = _sides(spark, sf, "case when qty > 25 then 1 else 0 end", "case when qty > 25 then 1000 else 0 end", ())
    rows = []
    for name, metric, digits, a, b, settings in (("linear_regression", "mse", 3, left, right, {}), ("kmeans", "inertia", 0, apart, None, {"n_clusters": 2}),
                                                 ("pca", "explained_variance", 6, left, None, {"n_components": 1}), ("decision_tree", "accuracy", 6, classes, held, {})):
        rows.append((name, metric, round(float(train_model(name, a, b, settings).metrics[metric]), digits)))
    try:
        train_model("perceptron", left, right)
    except ValueError:
        rows.append(("perceptron", "refused", float("perceptron" not in MODEL_TYPES)))
    return spark.createDataFrame(rows, "model string, metric string, value double")


@query("held_out_inertia", L + f", p as (select *, {_APART} as x, qty > 25 as g from d), m as (select g, avg(x) as c from p where not test group by g), "
       "s as (select round(sum((x - c) ^ 2) filter (not test), 0) as a, round(sum((x - c) ^ 2) filter (test), 0) as b from p join m using (g)) "
       "select a as train_inertia, b as test_inertia, a as progress from s")
def _(spark, sf):
    """Inertia on both sides of the split, and the progress series, which ends with that of training."""
    fitted = train("kmeans", *_sides(spark, sf, "y", _APART), n_clusters=2)
    row = (round(fitted.metrics["train_inertia"], 0), round(fitted.metrics["test_inertia"], 0), round(fitted.progress[-1], 0))
    return spark.createDataFrame([row], "train_inertia double, test_inertia double, progress double")


@query("empty_datasets", "select o_orderstatus as status, count(*) as n, case when o_orderstatus = 'none' then 'empty' else 'done' end as outcome from orders group by o_orderstatus "
       "union all select 'none', 0, 'empty'")
def _(spark, sf):
    """Each status is a dataset of its own; one without rows is left out and said to be empty."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    names = [r[0] for r in orders.select("o_orderstatus").distinct().collect()]  # a few fixed letters
    paths = {name: new_folder(spark, "cleaned") for name in [*names, "none"]}
    spec = DatasetSpec(types={"o_orderkey": "int", "o_orderstatus": "object"})
    outcome = clean_all({name: (orders.where(F.col("o_orderstatus") == name), spec) for name in paths}, lambda name, df: df.write.parquet(paths[name]))
    counts = [(name, spark.read.parquet(paths[name]).count() if outcome[name] == "done" else 0, outcome[name]) for name in paths]
    return spark.createDataFrame(counts, "status string, n long, outcome string")
