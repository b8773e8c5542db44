"""Feature, split and score queries with their SQL twins."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.catalogue.inputs import BLOBS_SQL, DIRTY_SQL, LINE_KEY, LINES_SQL, blobs, dirty_orders, lines, split_sql, table
from tablewright.operators.silhouette import silhouette, silhouette_squared
from tablewright.functions.vectors import as_array, nearest
from tablewright.operators import features, metrics
from tablewright.operators.split import exact_split, with_split
from tablewright.plans.features import build_features
from tablewright.spec import DatasetSpec

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


D = f"with d as ({DIRTY_SQL})"
L = f"with d as ({LINES_SQL})"
_mode = lambda c, t="d": f"(select {c} from {t} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("impute_median", f"{D} select o_orderkey, round(coalesce(price, (select median(price::double) from d)), 4) as price from d")
def _(spark, sf):
    return _rounded(features.impute_median(dirty_orders(spark, sf, "o_orderkey", "price"), ["price"]), "price", digits=4)


@query("impute_mean", f"{D} select o_orderkey, round(coalesce(price, (select avg(price) from d)), 4) as price from d")
def _(spark, sf):
    return _rounded(features.impute_mean(dirty_orders(spark, sf, "o_orderkey", "price"), ["price"]), "price", digits=4)


@query("impute_frequent", f"{D} select o_orderkey, coalesce(prio, {_mode('prio')}) as prio from d")
def _(spark, sf):
    return features.impute_frequent(dirty_orders(spark, sf, "o_orderkey", "prio"), ["prio"])


_KEYS = ", ".join(LINE_KEY)


@query("standardize", f"select {_KEYS}, round((l_quantity - (select avg(l_quantity) from lineitem)) / (select stddev_pop(l_quantity) from lineitem), 6) as l_quantity, 0.0 as same from lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", F.lit(7.3).alias("same"))
    return _rounded(features.standardize(df, ["l_quantity", "same"]), "l_quantity", "same")


@query("minmax", f"select {_KEYS}, round((l_extendedprice - (select min(l_extendedprice) from lineitem)) / (select max(l_extendedprice) - min(l_extendedprice) from lineitem), 6) as l_extendedprice, 0.0 as same from lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_KEY, "l_extendedprice", F.lit(7.3).alias("same"))
    return _rounded(features.minmax(df, ["l_extendedprice", "same"]), "l_extendedprice", "same")


@query("one_hot", f"select {_KEYS}, " + ", ".join(f"case when l_returnflag = '{v}' then 1 else 0 end as l_returnflag_{v}" for v in "ANR") + " from lineitem")
def _(spark, sf):
    return features.one_hot_columns(table(spark, sf, "lineitem").select(*LINE_KEY, "l_returnflag"), "l_returnflag")


@query("datetime_parts", "select event_id, " + ", ".join(f"cast(floor({p}(ts)) as int) as ts_{p}" for p in features.DATETIME_PARTS) + " from events")
def _(spark, sf):
    return features.datetime_parts(table(spark, sf, "events").select("event_id", "ts"), "ts")


_CLOCK = "case when event_id % 3 = 0 then strftime(ts, '%H:%M:%S') when event_id % 3 = 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') else 'never' end"


@query("datetime_parts_text", f"with t as (select event_id, case when event_id % 3 = 0 then timestamp '1900-01-01' + (ts - date_trunc('day', ts)) when event_id % 3 = 1 then ts else timestamp '1900-01-01' end as ts from events) "
       "select event_id, " + ", ".join(f"cast(floor({p}(ts)) as int) as ts_{p}" for p in features.DATETIME_PARTS) + " from t")
def _(spark, sf):
    text = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "HH:mm:ss"))
            .when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("never"))
    return features.datetime_parts(table(spark, sf, "events").select("event_id", text.alias("ts")), "ts")


@query("label_encode", f"{D} select o_orderkey, (dense_rank() over (order by coalesce(prio, 'nan')) - 1)::double as prio, (dense_rank() over (order by status) - 1)::double as status from d")
def _(spark, sf):
    return features.label_encode(dirty_orders(spark, sf, "o_orderkey", "prio", "status"), ["prio", "status"])


@query("encode_target", f"{D} select o_orderkey, (dense_rank() over (order by status) - 1)::double as label from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "o_orderkey", "status")
    return features.label_encode(df, ["status"]).withColumnRenamed("status", "label")


@query("quick_features", f"{D} select o_orderkey::double as o_orderkey, round(coalesce(price, (select avg(price) from d)), 4) as price, "
       "(dense_rank() over (order by coalesce(prio, 'nan')) - 1)::double as prio, (dense_rank() over (order by status) - 1)::double as label from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "o_orderkey", "price", "prio", "status")
    return _rounded(features.quick_features(df, "status"), "price", digits=4)


@query("split", f"select o_orderkey, case when {split_sql('o_orderkey::varchar')} then 'test' else 'train' end as split from orders")
def _(spark, sf):
    return with_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 30)


@query("split_exact", "with h as (select o_orderkey, cast(('0x' || substr(md5('42:' || o_orderkey::varchar), 1, 13)) as bigint) as h from orders), "
       "r as (select o_orderkey, row_number() over (order by h) as r from h) "
       "select o_orderkey, case when r <= (select ceil(count(*) * 0.3) from h) then 'test' else 'train' end as split from r")
def _(spark, sf):
    return exact_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 30)


FEATURE_SPEC = DatasetSpec(
    types={"price": "float", "prio": "category", "odate": "date", "flag": "bool", "status": "category"},
    target_column="status", row_key=("o_orderkey",),
)
_PRIO = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_PARTS = ", ".join(f"{p}(o)::double as f{i + 6}" for i, p in enumerate(features.DATETIME_PARTS))


@query("build_features", f"{D}, i as (select *, coalesce(price, (select median(price::double) from d)) as pr, coalesce(prio, {_mode('prio')}) as pi, "
       "coalesce(odate, date '1900-01-01')::timestamp as o, (dense_rank() over (order by status) - 1)::double as label from d) "
       "select o_orderkey, label, round((pr - (select avg(pr) from i)) / (select stddev_pop(pr) from i), 6) as f0, "
       + ", ".join(f"case when pi = '{v}' then 1.0 else 0.0 end as f{i + 1}" for i, v in enumerate(_PRIO))
       + f", {_PARTS}, case when {split_sql('o_orderkey::varchar')} then 'test' else 'train' end as split from i")
def _(spark, sf):
    df = dirty_orders(spark, sf, "o_orderkey", "price", "prio", "odate", "flag", "status")
    train, test, model = build_features(df, FEATURE_SPEC)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    values = both.withColumn("v", vector_to_array("features"))
    return values.select("o_orderkey", "label", "split", *[
        F.round(F.col("v")[i], 6).alias(f"f{i}") for i in range(len(model.names))])


_COV = ("with m as (select var_samp(l_quantity) as a, covar_samp(l_quantity, l_tax * 100 + l_quantity) as b, var_samp(l_tax * 100 + l_quantity) as c from lineitem), "
        "e as (select (a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b ^ 2) as hi, a + c as total from m) ")


def _pair(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100 + F.col("l_quantity")).alias("mix"))
    return features.VectorAssembler(inputCols=["l_quantity", "mix"], outputCol="features").transform(df)


@query("pca_ratio", _COV + "select case when hi / total > 0.95 then 1 else 2 end as k, round(case when hi / total > 0.95 then hi / total else 1 end, 6) as explained from e")
def _(spark, sf):
    _, ratios = features.fit_pca(_pair(spark, sf), keep=0.95)
    return spark.createDataFrame([(len(ratios), round(sum(ratios), 6))], "k int, explained double")


@query("pca_k", _COV + "select 0 as component, round(hi / total, 6) as ratio from e union all select 1, round((total - hi) / total, 6) from e")
def _(spark, sf):
    _, ratios = features.fit_pca(_pair(spark, sf), k=2)
    return spark.createDataFrame([(i, round(r, 6)) for i, r in enumerate(ratios)], "component int, ratio double")


# ---- scores ---------------------------------------------------------------

_P = f"{L}, p as (select y, three as label, case when qty < 20 then 0 when disc < 0.05 then 1 else 2 end as prediction, 3 + 2 * qty - 40 * disc as guess from d)"


def _predicted(spark, sf):
    return lines(spark, sf, "y", "three", "qty", "disc").selectExpr(
        "y", "three as label", "case when qty < 20 then 0 when disc < 0.05 then 1 else 2 end as prediction",
        "3 + 2 * qty - 40 * disc as guess")


_CLASSES = (", k as (select c, count(*) filter (label = c and prediction = c)::double as tp, count(*) filter (label = c) as s, "
            "count(*) filter (prediction = c) as q from p, (values (0), (1), (2)) v(c) group by c) ")


@query("accuracy", f"{_P} select round(avg((label = prediction)::int), 6) as accuracy from p")
def _(spark, sf):
    return _rounded(metrics.accuracy(_predicted(spark, sf)), "accuracy")


for _name, _value in {
    "weighted_f1": ("f1", "case when s + q > 0 then 2 * tp / (s + q) else 0 end"),
    "weighted_precision": ("precision", "case when q > 0 then tp / q else 0 end"),
    "weighted_recall": ("recall", "case when s > 0 then tp / s else 0 end"),
}.items():
    def _run(spark, sf, column=_value[0]):
        return _rounded(metrics.classification_metrics(_predicted(spark, sf)), column).select(F.col(column).alias("score"))

    query(_name, f"{_P}{_CLASSES} select round(sum(s * {_value[1]}) / sum(s), 6) as score from k")(_run)


@query("mse", f"{_P} select round(avg((y - guess) * (y - guess)), 6) as mse from p")
def _(spark, sf):
    return _rounded(metrics.regression_metrics(_predicted(spark, sf), "y", "guess"), "mse").select("mse")


@query("r2", f"{_P} select round(1 - sum((y - guess) * (y - guess)) / (var_pop(y) * count(*)), 6) as r2 from p")
def _(spark, sf):
    return _rounded(metrics.regression_metrics(_predicted(spark, sf), "y", "guess"), "r2").select("r2")


_CENTRES = ((0.5, 0.5), (10.5, 10.5), (20.5, 0.5))
_DIST = [f"(x - {a}) * (x - {a}) + (y - {b}) * (y - {b})" for a, b in _CENTRES]


@query("inertia", f"with d as ({BLOBS_SQL}) select round(sum(least({', '.join(_DIST)})), 4) as inertia from d")
def _(spark, sf):
    df = blobs(spark, sf)
    return _rounded(metrics.inertia(df, as_array(df, ["x", "y"]), _CENTRES), "inertia", digits=4)


@query("kmeans_assign", f"with d as ({BLOBS_SQL}) select id, case when {_DIST[0]} <= least({_DIST[1]}, {_DIST[2]}) then 0 when {_DIST[1]} <= {_DIST[2]} then 1 else 2 end as cluster, "
       f"round(least({', '.join(_DIST)}), 6) as sq from d")
def _(spark, sf):
    df = blobs(spark, sf)
    best = nearest(as_array(df, ["x", "y"]), _CENTRES)
    return df.select("id", best["i"].alias("cluster"), F.round(best["d"], 6).alias("sq"))


@query("cluster_noise_counts", "select count(distinct case when c >= 0 then c end) as clusters, count(*) filter (c = -1) as noise from (select case when label = 9 then -1 else label end as c from embeddings)")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select(F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster"))
    return metrics.cluster_counts(df)


_SIL = ("with e as (select vec_id as id, label as c, embedding::double[] as x from embeddings), "
        "p as (select a.id, a.c, b.c as o, count(*) as n, sum(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2))))) as t from e a, e b group by all), "
        "s as (select id, sum(case when o = c then t / nullif(n - 1, 0) end) as a, min(case when o <> c then t / n end) as b from p group by id) ")


@query("silhouette", _SIL + "select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s")
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    return spark.createDataFrame([(round(silhouette(df, "embedding", "label"), 6),)], "silhouette double")


@query("silhouette_noise", _SIL.replace("label as c", "case when label = 9 then -1 else label end as c") + "select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s")
def _(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("cluster", F.when(F.col("label") == 9, -1).otherwise(F.col("label")))
    return spark.createDataFrame([(round(silhouette(df, "embedding", "cluster"), 6),)], "silhouette double")


@query("silhouette_squared", "with e as (select vec_id as id, label as c, embedding::double[] as x from embeddings), "
       "p as (select a.id, a.c, b.c as o, count(*) as n, sum(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2)))) as t from e a, e b group by all), "
       "s as (select id, sum(case when o = c then t / nullif(n - 1, 0) end) as a, min(case when o <> c then t / n end) as b from p group by id) "
       "select round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) as silhouette from s")
def _(spark, sf):
    df = table(spark, sf, "embeddings")
    return _rounded(silhouette_squared(df, "embedding", "label"), "silhouette")


@query("wide_one_hot_names", "select o_orderkey, concat('cust=', o_custkey) as name from orders")
def _(spark, sf):
    """The name of the slot that a wide category sets in the feature vector."""
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("string").alias("cust"))
    model = features.fit_features(df, DatasetSpec(types={"price": "float", "cust": "category"}), wide_categories=10)
    slots = model.set_slots(model.transform(df), "o_orderkey").where("position > 0 and value = 1")
    return slots.join(model.name_table(spark), "position").select("o_orderkey", "name")
