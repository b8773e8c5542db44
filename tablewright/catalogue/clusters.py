"""Clustering queries. Clusters are named by their smallest id, so labels can be compared."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.catalogue.inputs import BLOBS_SQL, RINGS_SQL, blobs, rings, table
from tablewright.clustering.centres import kmeans, minibatch_kmeans
from tablewright.clustering.density import dbscan
from tablewright.clustering.hierarchy import agglomerative, birch
from tablewright.clustering.modes import mean_shift
from tablewright.clustering.spectral import spectral
from tablewright.operators.lookup import lookup
from tablewright.runtime import cut

QUERIES, ORACLES = {}, {}
XY = ["x", "y"]
# Separated squares of points: every method must find them whole.
_TRUE = f"select id, min(id) over (partition by truth) as cluster from ({BLOBS_SQL})"


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def named(labels, id_column="id"):
    labels = cut(labels.select(id_column, "cluster"), "labels")  # read twice below
    first = labels.groupBy("cluster").agg(F.min(id_column).alias("first"))
    return lookup(labels, cut(first, "names"), "cluster", "cluster", "first").select(id_column, F.col("first").alias("cluster"))


def _vectors(spark, sf):
    return VectorAssembler(inputCols=XY, outputCol="features").transform(blobs(spark, sf)).select("id", "features")


@query("kmeans", _TRUE)
def _(spark, sf):
    df = _vectors(spark, sf)
    model, _ = kmeans(df, {"n_clusters": 3, "n_init": 3})
    return named(model.transform(df).select("id", F.col("prediction").alias("cluster")))


@query("minibatch_kmeans", _TRUE)
def _(spark, sf):
    df = _vectors(spark, sf)
    model, _ = minibatch_kmeans(df, {"n_clusters": 3, "max_iter": 8, "batch_size": 512})
    return named(model.transform(df).select("id", F.col("prediction").alias("cluster")))


@query("dbscan", _TRUE)
def _(spark, sf):
    return named(dbscan(blobs(spark, sf), "id", XY, eps=0.5, min_samples=5).select("id", "cluster"))


_NEAR = ("with c as (select c_custkey as id, c_acctbal / 1000 as x, c_nationkey / 10.0e0 as y from customer), "
         "p as (select a.id, b.id as o from c a join c b on b.x between a.x - 0.16 and a.x + 0.16 and sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2) <= 0.15), "
         "k as (select id from p group by id having count(*) >= 6), ")


def _customers(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey as id", "c_acctbal / 1000 as x", "c_nationkey / 10.0e0 as y")


@query("dbscan_counts", _NEAR + "b as (select distinct p.id from p join k on p.o = k.id where p.id not in (select id from k)) "
       "select (select count(*) from k) as core, (select count(*) from b) as border, (select count(*) from c) - (select count(*) from k) - (select count(*) from b) as noise")
def _(spark, sf):
    labels = dbscan(_customers(spark, sf), "id", XY, eps=0.15, min_samples=6)
    return labels.agg(
        F.count_if("core").alias("core"), F.count_if(~F.col("core") & (F.col("cluster") >= 0)).alias("border"),
        F.count_if(F.col("cluster") == -1).alias("noise"))


_NEAR_VECTORS = ("with c as (select vec_id as id, embedding::double[] as x from embeddings), "
                 "p as (select a.id, b.id as o from c a join c b on list_distance(a.x, b.x) <= 1.18), "
                 "k as (select id from p group by id having count(*) >= 5), ")


@query("dbscan_vectors", _NEAR_VECTORS + "b as (select distinct p.id from p join k on p.o = k.id where p.id not in (select id from k)) "
       "select (select count(*) from k) as core, (select count(*) from b) as border, (select count(*) from c) - (select count(*) from k) - (select count(*) from b) as noise")
def _(spark, sf):
    """Points of many columns, for which cells are those of pivots."""
    vectors = table(spark, sf, "embeddings").selectExpr("vec_id as id", "cast(embedding as array<double>) as x")
    labels = dbscan(vectors, "id", "x", eps=1.18, min_samples=5)
    return labels.agg(
        F.count_if("core").alias("core"), F.count_if(~F.col("core") & (F.col("cluster") >= 0)).alias("border"),
        F.count_if(F.col("cluster") == -1).alias("noise"))


@query("agglomerative", _TRUE)
def _(spark, sf):
    return named(agglomerative(blobs(spark, sf), "id", XY, n_clusters=3))


@query("agglomerative_average", _TRUE)
def _(spark, sf):
    return named(agglomerative(blobs(spark, sf), "id", XY, n_clusters=None, linkage="average", distance_threshold=5.0))


@query("agglomerative_single", _TRUE)
def _(spark, sf):
    return named(agglomerative(blobs(spark, sf), "id", XY, n_clusters=None, linkage="single", distance_threshold=0.5))


@query("birch", _TRUE)
def _(spark, sf):
    return named(birch(blobs(spark, sf), "id", XY, threshold=0.5, n_clusters=3))


@query("mean_shift", _TRUE)
def _(spark, sf):
    return named(mean_shift(blobs(spark, sf), "id", XY, bandwidth=2.0))


@query("mean_shift_estimated", _TRUE)
def _(spark, sf):
    return named(mean_shift(blobs(spark, sf), "id", XY))


@query("spectral", _TRUE)
def _(spark, sf):
    return named(spectral(blobs(spark, sf), "id", XY, n_clusters=3, n_init=3))


@query("spectral_rings", f"select id, min(id) over (partition by truth) as cluster from ({RINGS_SQL})")
def _(spark, sf):
    return named(spectral(rings(spark, sf), "id", ["x", "y", "z"], n_clusters=2, n_init=1, affinity="nearest_neighbors", n_neighbors=8))


@query("agglomerative_single_rings", f"select id, min(id) over (partition by truth) as cluster from ({RINGS_SQL})")
def _(spark, sf):
    return named(agglomerative(rings(spark, sf), "id", ["x", "y", "z"], n_clusters=2, linkage="single"))
