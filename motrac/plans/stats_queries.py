"""Regression, batches, bulk profiles, distances and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from motrac.operators import embed as E
from motrac.operators import koopman as Q
from motrac.operators import lineage as L
from motrac.operators import stats as T
from motrac.plans.registry import r, registry
from motrac.sources.fixtures import OBS_SQL, features, observations, table

QUERIES, SQL, query = registry()

BULK_SQL = """pf AS (SELECT c_mktsegment AS condition, p_brand AS gene, avg(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
sp AS (SELECT c_mktsegment AS condition, o_orderstatus AS state, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), pr AS (SELECT condition, state, n / sum(n) OVER (PARTITION BY condition) AS p FROM sp),
sf AS (SELECT o_orderstatus AS state, p_brand AS gene, avg(l_extendedprice) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
al AS (SELECT p_brand AS gene, avg(l_extendedprice) AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
fc AS (SELECT condition, gene, v / m AS fc FROM pf JOIN al USING (gene)), sfc AS (SELECT state, gene, v / m AS fc FROM sf JOIN al USING (gene))"""
DIST_SQL = "dm AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM embeddings a, embeddings b)"


def _bulk(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderstatus").alias("state"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("condition"))
    rows = li.join(part, "l_partkey").join(orders, "l_orderkey").join(cust, "o_custkey")
    # One pass over the joined rows gives every mean, by summing sums of the finest groups.
    fine = rows.groupBy("condition", "state", "gene").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"))
    mean = lambda *by: fine.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("v"))
    whole = F.broadcast(mean("gene").withColumnRenamed("v", "m"))
    share = orders.join(cust, "o_custkey").groupBy("condition", "state").agg(F.count("*").alias("n"))
    probs = share.select("condition", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("condition"))).alias("p"))
    return mean("condition", "gene").join(whole, "gene").select("condition", "gene", (F.col("v") / F.col("m")).alias("fc")), probs, mean("state", "gene").join(whole, "gene").select("state", "gene", (F.col("v") / F.col("m")).alias("fc"))


@query("SELECT l_returnflag, round(((sum(l_tax * l_tax) * sum(l_quantity * l_extendedprice)) - sum(l_quantity * l_tax) * sum(l_tax * l_extendedprice)) / (sum(l_quantity * l_quantity) * sum(l_tax * l_tax) - sum(l_quantity * l_tax) ** 2), 3) AS ca, round(((sum(l_quantity * l_quantity) * sum(l_tax * l_extendedprice)) - sum(l_quantity * l_tax) * sum(l_quantity * l_extendedprice)) / (sum(l_quantity * l_quantity) * sum(l_tax * l_tax) - sum(l_quantity * l_tax) ** 2), 3) AS cb FROM lineitem GROUP BY l_returnflag")
def linear_coef(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return T.linear_coef(li, F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax"), ["l_returnflag"]).select("l_returnflag", r("ca", 3).alias("ca"), r("cb", 3).alias("cb"))


def batch_normalization(spark, sf_dir):
    """Coefficients that bring prices of returned lines to those of others."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("v"))
    a, b = T.batch_normalization(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"))
    return spark.createDataFrame([(round(a, 6), round(b, 4))], "a double, b double")


@query(f"WITH {OBS_SQL} SELECT CAST(least(floor(x / 25), 19) AS INT) AS bin, count(*) AS n FROM obs WHERE x BETWEEN 0 AND 500 GROUP BY 1")
def histogram_1d(spark, sf_dir):
    return T.histogram(observations(spark, sf_dir), "x", 0.0, 500.0, 20)


@query(f"WITH {OBS_SQL}, h AS (SELECT CAST(least(floor(x / 25), 19) AS INT) AS bin, count(*) AS n FROM obs WHERE x BETWEEN 0 AND 500 GROUP BY 1) SELECT bin, n, round(1 - sum(n) OVER (ORDER BY n, bin) / sum(n) OVER (), 6) + 0.0 AS level FROM h")
def cdist(spark, sf_dir):
    return T.credible_level(T.histogram(observations(spark, sf_dir), "x", 0.0, 500.0, 20), "n").select("bin", "n", r("level").alias("level"))


@query(f"WITH {OBS_SQL} SELECT CAST(floor(x / 50.0) AS INT) AS ix, CAST(floor(y / 50.0) AS INT) AS iy, round(sum(state) / (count(*) + 1), 6) AS value FROM obs GROUP BY ALL")
def mesh_average(spark, sf_dir):
    return T.mesh_average(observations(spark, sf_dir), "state", "x", "y", 50.0).select("ix", "iy", r("value").alias("value"))


@query(f"WITH {BULK_SQL} SELECT condition, gene, round(sum(p * fc), 6) AS fc FROM pr JOIN sfc USING (state) GROUP BY ALL")
def predicted_fc(spark, sf_dir):
    _, probs, states = _bulk(spark, sf_dir)
    return T.predicted_fc(probs, states).select("condition", "gene", r("fc").alias("fc"))


@query(f"WITH {BULK_SQL}, p AS (SELECT condition, gene, sum(p * fc) AS pf FROM pr JOIN sfc USING (state) GROUP BY ALL) SELECT condition, round(corr(log2(fc), log2(pf)), 5) AS corr FROM p JOIN fc USING (condition, gene) GROUP BY condition")
def prediction_correlation(spark, sf_dir):
    fc, probs, states = _bulk(spark, sf_dir)
    both = T.predicted_fc(probs, states).withColumnRenamed("fc", "pf").join(fc, ["condition", "gene"])
    return T.log_correlation(both, "condition", "fc", "pf").select("condition", r("corr", 5).alias("corr"))


def state_decomposition(spark, sf_dir):
    fc, probs, _ = _bulk(spark, sf_dir)
    p = probs.toPandas().pivot(index="condition", columns="state", values="p").fillna(0.0)
    return T.state_decomposition(fc, pd.DataFrame(p)).select("gene", "state", r("fc").alias("fc"))


def null_correlations(spark, sf_dir):
    fc, probs, states = _bulk(spark, sf_dir)
    conditions = [x[0] for x in probs.select("condition").distinct().orderBy("condition").collect()]
    return T.null_correlations(fc, states, conditions).select("draw", "condition", r("corr").alias("corr"))


@query(f"WITH {DIST_SQL} SELECT i, j, round(d, 6) AS d FROM dm")
def dmat(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.distance_rows(f, f).select("i", "j", r("d").alias("d"))


@query(f"WITH {DIST_SQL} SELECT i, j, round(d, 6) AS d, CAST(row_number() OVER (PARTITION BY i ORDER BY d, j) AS INT) AS rank FROM dm WHERE i <> j AND i % 100 = 0 QUALIFY rank <= 5")
def knn_topk(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.knn(f.where("cell_id % 100 = 0"), f, 5).select("i", "j", r("d").alias("d"), "rank")


@query("""WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, k, avg(v) AS v FROM u GROUP BY ALL),
d AS (SELECT u.vec_id, c.label AS cluster, sqrt(sum((u.v - c.v) * (u.v - c.v))) AS d FROM u JOIN c USING (k) GROUP BY ALL) SELECT vec_id AS cell_id, cluster, round(d, 6) AS d FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1""")
def assign_nearest_center(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.assign(f, E.mean_centers(f, "label")).select("cell_id", "cluster", r("d").alias("d"))


@query(f"WITH {DIST_SQL} SELECT i, j, round(exp(-d * d / 1.0), 6) AS k FROM dm")
def gaussian_kernel(spark, sf_dir):
    f = features(spark, sf_dir)
    return Q.gaussian_kernel_rows(f, f, 0.5).select("i", "j", r("k").alias("k"))


@query(f"WITH {DIST_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM dm), a AS (SELECT i, j, exp(-d * d / 1.0) AS a FROM n WHERE k <= 25) SELECT i, j, round(a / sum(a) OVER (PARTITION BY i), 6) AS p FROM a")
def diffusion_kernel_rownorm(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.diffusion_kernel(f, 0.5, 25).select("i", "j", r("p").alias("p"))


@query(f"WITH {DIST_SQL}, e AS (SELECT unnest([0.01, 0.1, 1.0, 10.0])::DOUBLE AS eps) SELECT eps, round(ln(sum(exp(-d * d / (2 * eps)))), 6) AS log_sum FROM dm, e GROUP BY eps")
def scaled_sigma_curve(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.sigma_curve(f, [0.01, 0.1, 1.0, 10.0]).select("eps", r("log_sum").alias("log_sum"))


@query(f"WITH {DIST_SQL} SELECT i, round(0.05 * var_pop(d), 6) AS sigma FROM dm GROUP BY i")
def kernel_sigma_vector(spark, sf_dir):
    f = features(spark, sf_dir)
    return E.distance_variance(f, f).select("i", r(0.05 * F.col("var")).alias("sigma"))


@query("SELECT round(0.05 * sqrt(var_pop(v)), 6) AS sigma FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
def kernel_sigma_scalar(spark, sf_dir):
    return features(spark, sf_dir).select(F.explode("xf").alias("v")).agg(r(0.05 * F.sqrt(F.var_pop("v"))).alias("sigma"))


@query(f"WITH {OBS_SQL}, s AS (SELECT traj_id, pos, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM obs WINDOW w AS (PARTITION BY traj_id ORDER BY pos)) SELECT traj_id, pos, round(x0, 3) AS f0, round(y0, 3) AS f1, round(x2, 3) AS f4, round(y2, 3) AS f5 FROM s WHERE x2 IS NOT NULL")
def segment_concat(spark, sf_dir):
    o = observations(spark, sf_dir)
    s = E.segment_features(L.segments(o, 3), o.select("cell_id", F.array("x", "y").alias("xf")))
    return s.select("traj_id", "pos", *[r(F.col("xf")[k], 3).alias(f"f{k}") for k in (0, 1, 4, 5)])


def pca(spark, sf_dir):
    return E.pca(features(spark, sf_dir), 0.5)[0].select("cell_id", F.transform("x", lambda v: F.round(v, 4)).alias("x"))


def kmeans_clusters(spark, sf_dir):
    return E.kmeans(features(spark, sf_dir), 5)[1]


for f in (batch_normalization, state_decomposition, null_correlations, pca, kmeans_clusters):
    QUERIES[f.__name__] = f
