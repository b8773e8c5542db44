"""Trainer queries; those with a closed form have an SQL twin."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.catalogue.inputs import LINES_SQL, lines, split_sql, table
from tablewright.learners.catalogue import CLASSIFIERS, REGRESSORS, train
from tablewright.operators import metrics
from tablewright.operators.split import is_test
from tablewright.plans.flagship import flagship
from tablewright.plans.train import train_job
from tablewright.runtime import cut

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


L = f"with d as (select *, {split_sql('k')} as test from ({LINES_SQL}))"


def sides(spark, sf, label, *features):
    """(train, test) of lineitem with k, features, label; features are SQL expressions."""
    df = lines(spark, sf).selectExpr("k", f"cast({label} as double) as label", *[f"cast({e} as double) as f{i}" for i, e in enumerate(features)])
    ready = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(df)
    # written once: fitting reads its side many times
    marked = cut(ready.select("k", "features", "label", is_test("k").alias("test")), "sides")
    return marked.where("not test").drop("test"), marked.where("test").drop("test")


def scores(spark, trained):
    rows = [(k, None if v is None else round(float(v), 6)) for k, v in sorted(trained.metrics.items())]
    return spark.createDataFrame(rows, "metric string, value double")


# ---- one-feature linear models: coefficients and test errors in closed form

_LINEAR = (", m as (select avg(qty) as mx, avg(y) as my, covar_pop(qty, y) as c, var_pop(qty) as v, count(*) as n from d where not test), "
           "w as (select {slope} as slope, my - {slope} * mx as intercept from m), "
           "e as (select sum((y - slope * qty - intercept) ^ 2) as s, var_pop(y) * count(*) as t, count(*) as n from d, w where test) "
           "select round(slope, 4) as slope, round(intercept, 3) as intercept, round(s / n, 3) as mse, round(1 - s / t, 5) as r2 from w, e")


def _linear(name, **hyper):
    def run(spark, sf):
        left, right = sides(spark, sf, "y", "qty")
        model = train(name, left, **hyper).model
        tested = metrics.regression_metrics(model.transform(right)).first()
        row = (round(float(model.coefficients[0]), 4), round(float(model.intercept), 3), round(tested.mse, 3), round(tested.r2, 5))
        return spark.createDataFrame([row], "slope double, intercept double, mse double, r2 double")

    return run


for _name, _trainer, _slope, _hyper in (
    ("ols_1d", "linear_regression", "c / v", {}),
    ("ridge_1d", "ridge", "c / (v + 50000.0 / n)", {"alpha": 50000.0}),
    ("lasso_1d", "lasso", "sign(c) * greatest(abs(c) - 20, 0) / v", {"alpha": 20.0}),
    ("elastic_net_1d", "elastic_net", "sign(c) * greatest(abs(c) - 10, 0) / (v + 10)", {"alpha": 20.0, "l1_ratio": 0.5}),
    ("ols_positive_1d", "linear_regression", "greatest(c, 0) / v", {"positive": True}),
):
    query(_name, L + _LINEAR.format(slope=_slope))(_linear(_trainer, **_hyper))


# ---- neighbours

_NEAR = (f"with e as (select vec_id as id, label, embedding::double[] as x, {split_sql('vec_id::varchar')} as test from embeddings), "
         "p as (select q.id as vec_id, r.id as rid, r.label, sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda z: pow(z[1] - z[2], 2)))) as d from e q, e r where q.test and not r.test), "
         "k as (select *, row_number() over (partition by vec_id order by d, rid) as rn from p) ")


def _vectors(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    return df.where(~is_test("vec_id")), df.where(is_test("vec_id"))


def _neighbours(name, **hyper):
    def run(spark, sf):
        left, right = _vectors(spark, sf)
        model, _ = {**CLASSIFIERS, **REGRESSORS}[name](left, {"id_column": "vec_id", **hyper})
        return model.transform(right, "vec_id").select("vec_id", F.round("prediction", 6).alias("prediction"))

    return run


query("knn_classify", _NEAR + ", v as (select vec_id, label, count(*) as n from k where rn <= 5 group by vec_id, label) "
      "select vec_id, (arg_min(label, (-n) * 100 + label))::double as prediction from v group by vec_id")(_neighbours("knn_classifier"))
query("knn_classify_distance", _NEAR + ", v as (select vec_id, label, sum(1 / d) as n from k where rn <= 7 group by vec_id, label), "
      "r as (select vec_id, label, row_number() over (partition by vec_id order by n desc, label) as o from v) "
      "select vec_id, label::double as prediction from r where o = 1")(_neighbours("knn_classifier", n_neighbors=7, weights="distance"))
query("knn_regress", _NEAR + "select vec_id, round(avg(label), 6) as prediction from k where rn <= 5 group by vec_id")(_neighbours("knn_regressor"))
query("knn_regress_distance", _NEAR + "select vec_id, round(sum(label / d) / sum(1 / d), 6) as prediction from k where rn <= 5 group by vec_id")(
    _neighbours("knn_regressor", weights="distance"))


# ---- naive Bayes: fitted on the training side, predicted on the test side

def _bayes(name, *features, **hyper):
    def run(spark, sf):
        left, right = sides(spark, sf, "three", *features)
        return train(name, left, **hyper).model.transform(right).select("k", F.col("prediction").cast("int").alias("prediction"))

    return run


_COUNTS = ("qty", "round(disc * 100)", "round(tax * 100)")
_T = L + ", t as (select k, three, test, " + ", ".join(f"({e})::double as f{i}" for i, e in enumerate(_COUNTS)) + " from d)"
_PICK = " select k, prediction from (select k, c as prediction, row_number() over (partition by k order by s desc, c) as o from s) where o = 1"

query("gaussian_nb", _T + ", g as (select 1e-9 * greatest(var_pop(f0), var_pop(f1), var_pop(f2)) as eps from t where not test), "
      "m as (select three as c, count(*)::double as n, " + ", ".join(f"avg(f{i}) as m{i}, var_pop(f{i}) + (select eps from g) as v{i}" for i in range(3)) + " from t where not test group by three), "
      "s as (select k, c, ln(n / (select sum(n) from m)) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{i}) + (f{i} - m{i}) ^ 2 / v{i}" for i in range(3)) + ") as s from t, m where test)" + _PICK)(
    _bayes("gaussian_nb", *_COUNTS))

_SUMS = _T + ", m as (select three as c, count(*)::double as n, " + ", ".join(f"sum(f{i}) as s{i}" for i in range(3)) + " from t where not test group by three), "
query("multinomial_nb", _SUMS + "s as (select k, c, ln(n / (select sum(n) from m)) + " + " + ".join(f"f{i} * ln((s{i} + 1) / (s0 + s1 + s2 + 3))" for i in range(3)) + " as s from t, m where test)" + _PICK)(
    _bayes("multinomial_nb", *_COUNTS))
query("complement_nb", _SUMS + "a as (select " + ", ".join(f"sum(s{i}) as a{i}" for i in range(3)) + " from m), r as (select c, " + ", ".join(f"a{i} - s{i} + 1 as r{i}" for i in range(3)) + " from m, a), "
      "s as (select k, c, " + " + ".join(f"f{i} * -ln(r{i} / (r0 + r1 + r2))" for i in range(3)) + " as s from t, r where test)" + _PICK)(
    _bayes("complement_nb", *_COUNTS))

_FLAGS = ("qty - 20", "disc - 0.045", "tax - 0.035")
_B = L + ", t as (select k, three, test, " + ", ".join(f"(({e}) > 0)::int::double as f{i}" for i, e in enumerate(_FLAGS)) + " from d), m as (select three as c, count(*)::double as n, " + ", ".join(f"(sum(f{i}) + 1) / (count(*) + 2) as p{i}" for i in range(3)) + " from t where not test group by three), "
query("bernoulli_nb", _B + "s as (select k, c, ln(n / (select sum(n) from m)) + " + " + ".join(f"f{i} * ln(p{i}) + (1 - f{i}) * ln(1 - p{i})" for i in range(3)) + " as s from t, m where test)" + _PICK)(
    _bayes("bernoulli_nb", *_FLAGS))

_CODES = ("floor(qty / 10)", "round(disc * 100)", "round(tax * 100)")
_C = L + ", t as (select k, three, test, " + ", ".join(f"({e})::int as f{i}" for i, e in enumerate(_CODES)) + " from d), m as (select three as c, count(*)::double as n from t where not test group by three)" + "".join(
    f", c{i} as (select m.c, v.v, ln((coalesce(q.n, 0) + 1) / (m.n + (select max(f{i}) + 1 from t where not test))) as l from m cross join (select distinct f{i} as v from t) v "
    f"left join (select three, f{i}, count(*) as n from t where not test group by all) q on q.three = m.c and q.f{i} = v.v)" for i in range(3))
query("categorical_nb", _C + ", s as (select t.k, m.c, ln(m.n / (select sum(n) from m)) + c0.l + c1.l + c2.l as s from t, m, c0, c1, c2 where t.test and " + " and ".join(
    f"c{i}.c = m.c and c{i}.v = t.f{i}" for i in range(3)) + ")" + _PICK)(_bayes("categorical_nb", *_CODES))


# ---- trees: these targets are step functions the trees recover exactly

def _exact(name, label, *features, **hyper):
    def run(spark, sf):
        left, right = sides(spark, sf, label, *features)
        return train(name, left, **hyper).model.transform(right).select("k", F.col("prediction").cast("int").alias("prediction"))

    return run


_TWO, _THREE = (L + f" select k, {c} as prediction from d where test" for c in ("two", "three"))
query("tree_classify", _TWO)(_exact("decision_tree", "two", "qty", "disc", max_depth=3, max_bins=64))
query("forest_classify", _THREE)(_exact("random_forest", "three", "qty", "disc", n_estimators=5, max_depth=4, max_bins=64, max_features=None, bootstrap=False))
query("tree_regress", _THREE)(_exact("decision_tree_regressor", "three", "qty", "disc", max_depth=3, max_bins=64))
query("forest_regress", _THREE)(_exact("random_forest_regressor", "three", "qty", "disc", n_estimators=5, max_depth=4, max_bins=64, bootstrap=False))
query("gbt_classify", _TWO)(_exact("gradient_boosting", "two", "qty", "disc", n_estimators=5, max_depth=3, max_bins=64))


# ---- iterative trainers on targets that they reach exactly, or with a known solution

_HALF = "case when qty > 25 then 1 else 0 end"
_UPPER = L + f" select k, {_HALF} as prediction from d where test"
query("ada_boost_classify", _UPPER)(_exact("ada_boost_classifier", _HALF, "qty", "disc", n_estimators=5, max_bins=64))
query("svc", _UPPER)(_exact("svc", _HALF, "(qty - 25.5) / 5", kernel="linear", C=100.0, max_iter=200))
query("mlp", _UPPER)(_exact("mlp", _HALF, "(qty - 25.5) / 5", max_iter=100, hidden_layer_sizes=(4,)))
# Labels are any numbers; the trainers see 0, 1, ..., k - 1.
query("tree_classify_signs", L + " select k, 2 * two - 1 as prediction from d where test")(
    _exact("decision_tree", "2 * two - 1", "qty", "disc", max_depth=3, max_bins=64))
query("gbt_classify_tens", L + " select k, 10 * two + 10 as prediction from d where test")(
    _exact("gradient_boosting", "10 * two + 10", "qty", "disc", n_estimators=5, max_depth=3, max_bins=64))
query("forest_classify_tens", L + " select k, 10 * three + 10 as prediction from d where test")(
    _exact("random_forest", "10 * three + 10", "qty", "disc", n_estimators=5, max_depth=4, max_bins=64, max_features=None, bootstrap=False))


@query("ada_boost_regress", L + " select k, three as prediction from d where test")
def _(spark, sf):
    left, right = sides(spark, sf, "three", "qty", "disc")
    model = train("ada_boost_regressor", left, n_estimators=5, max_bins=64).model
    return model.transform(right).select("k", F.round("prediction").cast("int").alias("prediction"))


@query("svr", L + " select k, cast(2 * qty as int) as prediction from d where test")
def _(spark, sf):
    """A line without noise: predictions lie within epsilon of it."""
    left, right = sides(spark, sf, "2 * qty", "qty / 10")
    model = train("svr", left, kernel="linear", epsilon=0.1, C=10.0).model
    return model.transform(right).select("k", F.round("prediction").cast("int").alias("prediction"))


@query("logistic", L + ", b as (select (disc < 0.03)::int as f, avg(two) as p from d where not test group by 1) select round(ln(z.p / (1 - z.p)), 3) as intercept, "
       "round(ln(o.p / (1 - o.p)) - ln(z.p / (1 - z.p)), 3) as slope from b z, b o where z.f = 0 and o.f = 1")
def _(spark, sf):
    """One binary feature without a penalty: log odds."""
    left, _ = sides(spark, sf, "two", "case when disc < 0.03 then 1 else 0 end")
    model = train("logistic_regression", left, penalty="none", max_iter=300, tol=1e-12).model
    return spark.createDataFrame([(round(float(model.intercept), 3), round(float(model.coefficients[0]), 3))], "intercept double, slope double")


@query("train_job", f"with d as (select *, {split_sql('k', 0.2)} as test from ({LINES_SQL})), m as (select avg(qty) as mx, avg(y) as my, covar_pop(qty, y) / var_pop(qty) as slope from d where not test), "
       "e as (select sum((y - my - slope * (qty - mx)) ^ 2) as s, var_pop(y) * count(*) as t, count(*) as n from d, m where test) "
       "select 'mse' as metric, round(s / n, 6) as value from e union all select 'r2', round(1 - s / t, 6) from e")
def _(spark, sf):
    return scores(spark, train_job(lines(spark, sf, "k", "qty", "y"), "linear_regression", "y", key=["k"]))


@query("train_job_pca", f"with c as (select var_samp(qty) as a, var_samp(tax * 500) as b, covar_samp(qty, tax * 500) as c from ({LINES_SQL})) "
       "select 'explained_variance' as metric, round((a + b + sqrt((a - b) ^ 2 + 4 * c * c)) / 2 / (a + b), 6) as value from c")
def _(spark, sf):
    """Two columns: the larger eigenvalue of a two by two matrix."""
    df = lines(spark, sf, "qty", "tax").select("qty", (F.col("tax") * 500).alias("tax"))
    return scores(spark, train_job(df, "pca", hyperparameters={"n_components": 1}))


@query("flagship")
def _(spark, sf):
    return flagship(spark, sf)
