"""Grouped numeric operators: shape features, boundary clouds, Koopman models, streaming. Tests hold them against invariants."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from motrac.functions import scalar as S
from motrac.operators import boundary as B
from motrac.operators import cells as C
from motrac.operators import embed as E
from motrac.operators import features as X
from motrac.operators import koopman as Q
from motrac.plans.registry import r, registry
from motrac.sources.fixtures import OBS_SQL, PIXEL_SQL, features, observations, pixels
from motrac.streaming import transitions

QUERIES, SQL, query = registry()


def cell_features(spark, sf_dir):
    names = ["size", "mean_intensity", "total_intensity", "zernike", "haralick", "boundary_fft", "nucleus_boundary_fft", "contact_fft"]
    return X.cell_features(pixels(spark, sf_dir), "c1", names).select("frame", "label", F.transform("xf", lambda v: F.round(v, 6)).alias("xf"))


@query(f"WITH {PIXEL_SQL} SELECT frame, label, CAST(count(*) AS DOUBLE) AS size, round(avg(c1), 6) AS mean, round(sum(c1), 6) AS total FROM pixels WHERE label > 0 GROUP BY ALL")
def region_features(spark, sf_dir):
    f = X.cell_features(pixels(spark, sf_dir), "c1", ["size", "mean_intensity", "total_intensity"])
    return f.select("frame", "label", F.col("xf")[0].alias("size"), r(F.col("xf")[1]).alias("mean"), r(F.col("xf")[2]).alias("total"))


@query(f"WITH {PIXEL_SQL} SELECT frame, x, y, CASE WHEN y > 0 THEN c1 - lag(c1) OVER (PARTITION BY frame, x ORDER BY y) ELSE 0.0 END AS value FROM pixels")
def apply_slices(spark, sf_dir):
    def step(img):
        return np.diff(img, axis=0, prepend=img[:1])

    return X.apply_slices(pixels(spark, sf_dir), step, "c1", ["frame"])


def _cloud(spark, sf_dir):
    """Border pixels of the masks as points with a depth, a charge and a neighbour."""
    b = C.borders(pixels(spark, sf_dir))
    return b.select("frame", F.col("label").cast("long").alias("index"), F.array(F.col("x").cast("double"), F.col("y").cast("double"), ((F.col("x") + F.col("y")) % 3).cast("double")).alias("pt"), ((F.col("x") * 3 + F.col("y")) % 5 - 2).cast("double").alias("q"))


CLOUD_SQL = f"{PIXEL_SQL}, bo AS (SELECT frame, x, y, label FROM (SELECT p.frame, p.x, p.y, p.label, q.label AS other FROM pixels p JOIN pixels q ON p.frame = q.frame AND abs(p.x - q.x) + abs(p.y - q.y) = 1 WHERE p.label > 0) GROUP BY ALL HAVING count(*) < 4 OR bool_or(other <> label)), cl AS (SELECT frame, label, x, y, CAST((x + y) % 3 AS DOUBLE) AS z, CAST((x * 3 + y) % 5 - 2 AS DOUBLE) AS q FROM bo)"


@query(f"""WITH {CLOUD_SQL}, m AS (SELECT frame, label, q, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM cl WINDOW w AS (PARTITION BY frame, label))
SELECT frame, CAST(label AS BIGINT) AS index, round(avg(q), 6) + 0.0 AS l0, round(sqrt(avg(q * a) ** 2 + avg(q * b) ** 2 + avg(q * c) ** 2) / 3, 6) AS l1 FROM m GROUP BY ALL""")
def multipole_l01(spark, sf_dir):
    return B.multipoles(_cloud(spark, sf_dir), "q", ["frame", "index"]).select("frame", "index", r("l0").alias("l0"), r("l1").alias("l1"))


@query(f"""WITH {CLOUD_SQL}, d AS (SELECT a.frame, a.label, a.x, a.y, b.label AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM cl a JOIN cl b ON a.frame = b.frame AND a.label <> b.label)
SELECT frame, CAST(label AS BIGINT) AS index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(min(d), 6) AS d FROM d WHERE d <= 4 GROUP BY ALL""")
def boundary_neighbours(spark, sf_dir):
    return B.nearest_other(_cloud(spark, sf_dir), 4.0).select("frame", "index", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y"), r("d").alias("d"))


@query(f"""WITH {CLOUD_SQL}, d AS (SELECT a.frame, a.label, a.x, a.y, a.z, b.label AS other, b.x - a.x AS ax, b.y - a.y AS ay, b.z - a.z AS az, b.x AS bx, b.y AS byy, b.z AS bz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM cl a JOIN cl b ON a.frame = b.frame AND a.label <> b.label),
k AS (SELECT *, greatest(d, 2 / 2 ** (1.0 / 6)) AS rr, 2 / 2 ** (1.0 / 6) AS s FROM d WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY frame, label, x, y, z ORDER BY d, other, bx, byy, bz) = 1),
f AS (SELECT *, 0.1 * 48 * (s ** 12 / rr ** 13 - 0.5 * s ** 6 / rr ** 7) / d AS w FROM k), t AS (SELECT max(abs(w) * d) AS top FROM f), c AS (SELECT f.*, CASE WHEN top > 1 THEN 1 / top ELSE 1.0 END AS cap FROM f, t)
SELECT frame, CAST(label AS BIGINT) AS index, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(w * ax * cap, 6) + 0.0 AS dx, round(w * ay * cap, 6) + 0.0 AS dy, round(w * az * cap, 6) + 0.0 AS dz FROM c""")
def adhesive_displacement(spark, sf_dir):
    near = B.nearest_other(_cloud(spark, sf_dir), 4.0)
    out = B.adhesive_displacement(near, S.lj_force(F.col("d"), 1.0, 2.0), 0.1, 1.0)
    return out.select("frame", "index", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y"), *[r(F.col("dx")[k]).alias(c) for k, c in enumerate(("dx", "dy", "dz"))])


def surface_tension(spark, sf_dir):
    return B.surface_displacement(B.surface_normals(_cloud(spark, sf_dir))).select("frame", "index", "pt", F.transform("dx", lambda v: F.round(v, 6)).alias("dx"))


def flux_displacement(spark, sf_dir):
    return B.flux_displacement(B.surface_normals(_cloud(spark, sf_dir)), 0.1, 0.5, seed=3).select("frame", "index", "pt", F.transform("dx", lambda v: F.round(v, 6)).alias("dx"))


def transport_displacement(spark, sf_dir):
    """Each frame's borders against those of the same label in the frame before; cells are named by frame and label."""
    c = _cloud(spark, sf_dir)
    name = lambda shift: ((F.col("frame") + shift).cast("long") * 1000 + F.col("index")).alias("index")
    return B.transport_displacement(c.select(name(0), "pt"), c.select(name(1), "pt")).where("dx is not null")


def displacement_deviation(spark, sf_dir):
    moved = B.surface_displacement(B.surface_normals(_cloud(spark, sf_dir)))
    each = [B.displacement_deviation(moved, mode=m).select("frame", "index", "pt", F.lit(m).alias("mode"), r("dev").alias("dev")) for m in ("gradient", "plain", "eigen")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def volume_constraint(spark, sf_dir):
    return B.constrain_volume(_cloud(spark, sf_dir).select("frame", "index", "pt"), 100.0).groupBy("frame", "index").agg(r(F.first("volume"), 4).alias("volume"))


def ligand_density(spark, sf_dir):
    return B.ligand_density(pixels(spark, sf_dir)).select("frame", "x", "y", r("density").alias("density"))


def _whole_executor(spark):
    """A profile whose tasks have all cores of an executor, as all but one would idle; none where Spark has no such profiles or their number is not known."""
    conf, master = spark.sparkContext.getConf(), spark.sparkContext.master
    local = re.match(r"local-cluster\[\s*\d+\s*,\s*(\d+)", master)
    cores = int(conf.get("spark.executor.cores", local[1] if local else "1"))
    if cores < 2 or not re.match("local-cluster|spark:|yarn|k8s:", master) or conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build


def _series(spark, sf_dir, make, schema: pa.Schema):
    """What make has of all vectors in order, as a time series, in one task: an executor holds the matrices, the driver nothing, and the task has all its cores."""

    def run(batches):
        x = [np.asarray(b.column("xf").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1) for b in batches if b.num_rows]
        if x:
            table = pa.Table.from_pydict(dict(zip(schema.names, make(np.concatenate(x)))), schema=schema)
            yield from table.to_batches(max_chunksize=4096)

    rows = features(spark, sf_dir).select("cell_id", "xf").repartition(1).sortWithinPartitions("cell_id")
    return rows.mapInArrow(run, from_arrow_schema(schema), profile=_whole_executor(spark))


def _model(x):
    """Kernel model of a series: (identity metric, bandwidth, the five leading eigenvalues, right vectors, eigenfunctions, modes)."""
    m = np.eye(x.shape[1])
    h = Q.kernel_sigmas(x, m, 0.5, vector=False)
    return m, h, *Q.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)


def koopman_eigenvalues(spark, sf_dir):
    """Moduli of all eigenvalues of a kernel model over the rows as a time series."""

    def moduli(x):
        m = np.eye(x.shape[1])
        lam = np.sort(np.abs(np.linalg.eigvals(Q.koopman_operator(x[:-1], x[1:], m, Q.kernel_sigmas(x, m, 0.5)[:-1], 1e-2)[0])))[::-1]
        return np.arange(len(lam)), [round(float(v), 4) for v in lam]

    return _series(spark, sf_dir, moduli, pa.schema([("k", pa.int32()), ("modulus", pa.float64())]))


def koopman_inference(spark, sf_dir):
    """Four steps from each row, by the five leading modes."""

    def ahead(x):
        _, _, lam, _, phi, v = _model(x)
        out = Q.koopman_inference(np.arange(len(phi)), 4, phi, v, lam, 5)
        return np.repeat(np.arange(len(out)), 4), np.tile(np.arange(4), len(out)), [[round(float(z), 3) for z in row] for s in out for row in s]

    return _series(spark, sf_dir, ahead, pa.schema([("start", pa.int32()), ("step", pa.int32()), ("x", pa.list_(pa.float64()))]))


def _updated(name, update):
    def run(spark, sf_dir):
        def metric(x):
            out = np.abs(update(x[:-1], *_model(x)))
            return np.arange(len(out)), [[round(float(z), 4) + 0.0 for z in row] for row in out]

        return _series(spark, sf_dir, metric, pa.schema([("axis", pa.int32()), ("m", pa.list_(pa.float64()))]))

    run.__name__, run.__doc__ = name, "Moduli of the metric's entries after one update by five modes of a model of all rows."
    return run


metric_grad = _updated("metric_grad", lambda x, m, h, lam, xi, phi, v: Q.update_metric_grad(m, x, phi, h))
metric_jacobian = _updated("metric_jacobian", lambda x, m, h, lam, xi, phi, v: Q.update_metric_jacobian(m, x, xi, v, lam, h))
metric_jacobian_log = _updated("metric_jacobian_log", lambda x, m, h, lam, xi, phi, v: Q.update_metric_jacobian_log(m, x, phi, v, lam, h))
metric_flux = _updated("metric_flux", lambda x, m, h, lam, xi, phi, v: Q.update_metric_flux(m, x, phi, v, lam, h))


def diffusion_map(spark, sf_dir):
    """Three coordinates of each vector; the kernel keeps 25 neighbours a row, and these numbers alone reach the driver."""
    rows = E.diffusion_kernel(features(spark, sf_dir), 0.5, 25).toArrow()
    i, j, p = (rows.column(c).to_numpy() for c in "ijp")
    ids = np.unique(i)
    x = np.abs(E.sparse_diffusion_map(np.searchsorted(ids, i), np.searchsorted(ids, j), p, len(ids), 3))
    table = pa.table({"cell_id": ids.astype(np.int64), "x": pa.array([[round(float(v), 4) for v in row] for row in x], pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


@query(f"WITH {OBS_SQL}, st AS (SELECT state AS i, lead(state) OVER (PARTITION BY traj_id ORDER BY pos) AS j FROM obs) SELECT i, j, count(*) AS n FROM st WHERE j IS NOT NULL GROUP BY ALL")
def streaming_transitions(spark, sf_dir):
    """Transition counts kept while observations arrive."""
    return transitions.replay(observations(spark, sf_dir))


for f in (cell_features, surface_tension, flux_displacement, transport_displacement, displacement_deviation, volume_constraint, ligand_density, koopman_eigenvalues, koopman_inference, metric_grad, metric_jacobian, metric_jacobian_log, metric_flux, diffusion_map):
    QUERIES[f.__name__] = f
