"""Markov models of event types along users' trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from motrac.operators import markov as K
from motrac.plans.registry import r, registry
from motrac.sources.fixtures import OBS_SQL, observations

QUERIES, SQL, query = registry()

STEP_SQL = f"{OBS_SQL}, st AS (SELECT traj_id, pos, state AS i, lead(state) OVER (PARTITION BY traj_id ORDER BY pos) AS j FROM obs QUALIFY j IS NOT NULL)"
MATRIX_SQL = f"""{STEP_SQL}, sg AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(5) a, range(5) b), sc AS (SELECT sg.i, sg.j, count(st.i) AS n FROM sg LEFT JOIN st USING (i, j) GROUP BY ALL),
mt AS (SELECT i, j, CASE WHEN sum(n) OVER (PARTITION BY i) > 0 THEN n / sum(n) OVER (PARTITION BY i) WHEN i = j THEN 1.0 ELSE 0.0 END AS p FROM sc)"""


def _steps(spark, sf_dir):
    return K.state_steps(observations(spark, sf_dir))


def _matrix(spark, sf_dir):
    return K.transition_matrix(_steps(spark, sf_dir), 5)


@query(f"WITH {STEP_SQL} SELECT i, j, count(*) AS n FROM st GROUP BY ALL")
def transition_counts(spark, sf_dir):
    return K.transition_counts(_steps(spark, sf_dir))


@query(f"WITH {MATRIX_SQL} SELECT i, j, round(p, 6) AS p FROM mt")
def transition_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).select("i", "j", r("p").alias("p"))


@query(f"""WITH {STEP_SQL}, cg AS (SELECT CASE WHEN i < 2 THEN 0 WHEN i < 4 THEN 1 ELSE 2 END AS i, CASE WHEN j < 2 THEN 0 WHEN j < 4 THEN 1 ELSE 2 END AS j FROM st), sg AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(3) a, range(3) b),
sc AS (SELECT sg.i, sg.j, count(cg.i) AS n FROM sg LEFT JOIN cg USING (i, j) GROUP BY ALL) SELECT i, j, round(CASE WHEN sum(n) OVER (PARTITION BY i) > 0 THEN n / sum(n) OVER (PARTITION BY i) WHEN i = j THEN 1.0 ELSE 0.0 END, 6) AS p FROM sc""")
def transition_matrix_cg(spark, sf_dir):
    states = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)], "cluster int, state int")
    return K.transition_matrix(K.coarse_grain(_steps(spark, sf_dir), states), 3).select("i", "j", r("p").alias("p"))


@query(f"WITH {MATRIX_SQL} SELECT round(avg(-ln(p)), 6) AS entropy FROM st JOIN mt USING (i, j) WHERE p > 0")
def path_entropy(spark, sf_dir):
    return K.path_entropy(_steps(spark, sf_dir), _matrix(spark, sf_dir)).select(r("entropy").alias("entropy"))


@query(f"WITH {MATRIX_SQL} SELECT round(avg(-p * ln(p)), 6) AS entropy FROM st JOIN mt USING (i, j) WHERE p > 0 AND i <> j")
def path_entropy_weighted(spark, sf_dir):
    return K.path_entropy(_steps(spark, sf_dir), _matrix(spark, sf_dir), exclude_stays=True, weighted=True).select(r("entropy").alias("entropy"))


@query(f"WITH {MATRIX_SQL} SELECT round(avg(ln(p)), 6) AS ll FROM st JOIN mt USING (i, j) WHERE p > 0")
def path_ll(spark, sf_dir):
    return K.path_ll(_steps(spark, sf_dir), _matrix(spark, sf_dir)).select(r("ll").alias("ll"))


@query(f"WITH {MATRIX_SQL} SELECT traj_id, round(exp(avg(ln(p))), 6) AS gmean FROM st JOIN mt USING (i, j) WHERE p > 0 GROUP BY traj_id")
def traj_gmean(spark, sf_dir):
    return K.traj_gmean(_steps(spark, sf_dir), _matrix(spark, sf_dir)).select("traj_id", r("gmean").alias("gmean"))


@query(f"""WITH {MATRIX_SQL}, f AS (SELECT traj_id, avg(ln(p)) AS v FROM st JOIN mt USING (i, j) WHERE p > 0 GROUP BY traj_id), b AS (SELECT traj_id, avg(ln(p)) AS v FROM st JOIN mt ON st.i = mt.j AND st.j = mt.i WHERE p > 0 GROUP BY traj_id)
SELECT round(avg(f.v - b.v), 6) + 0.0 AS entropy_production FROM f JOIN b USING (traj_id)""")
def entropy_production(spark, sf_dir):
    return K.entropy_production(_steps(spark, sf_dir), _matrix(spark, sf_dir)).select(r("entropy_production").alias("entropy_production"))


@query(f"""WITH {MATRIX_SQL}, ce AS (SELECT state AS cluster, avg(x) AS x, avg(y) AS y FROM obs GROUP BY state)
SELECT a.cluster, round(sum((b.x - a.x) * p), 5) + 0.0 AS dx, round(sum((b.y - a.y) * p), 5) + 0.0 AS dy FROM mt JOIN ce a ON mt.i = a.cluster JOIN ce b ON mt.j = b.cluster GROUP BY a.cluster""")
def avdx_clusters(spark, sf_dir):
    centers = observations(spark, sf_dir).groupBy(F.col("state").alias("cluster")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return K.avdx_clusters(centers, _matrix(spark, sf_dir)).select("cluster", r("dx", 5).alias("dx"), r("dy", 5).alias("dy"))


def _committor_sql(n: int) -> str:
    out = f"WITH {MATRIX_SQL}, q0 AS (SELECT DISTINCT i AS state, CASE WHEN i = 4 THEN 1.0 ELSE 0.0 END AS q FROM mt)"
    for k in range(1, n + 1):
        out += f", q{k} AS (SELECT i AS state, CASE WHEN i = 4 THEN 1.0 WHEN i = 0 THEN 0.0 ELSE sum(p * q) END AS q FROM mt JOIN q{k - 1} ON mt.j = q{k - 1}.state GROUP BY i)"
    return out + f" SELECT state, round(q, 6) AS q FROM q{n}"


@query(_committor_sql(5))
def committor(spark, sf_dir):
    """Five sweeps of the committor from state 0 to 4 as joins."""
    return K.committor_steps(_matrix(spark, sf_dir), [4], [0], 5).select("state", r("q").alias("q"))


@query(f"""WITH RECURSIVE {MATRIX_SQL}, m AS (SELECT list(p ORDER BY i, j) AS a FROM mt), q(k, v) AS (SELECT 0, [0.0, 0.0, 0.0, 0.0, 1.0]::DOUBLE[] UNION ALL
SELECT k + 1, list_transform(range(5), lambda i: CASE i WHEN 4 THEN 1.0 WHEN 0 THEN 0.0 ELSE list_sum(list_transform(range(5), lambda j: a[i * 5 + j + 1] * v[j + 1])) END)::DOUBLE[] FROM q, m WHERE k < 400)
SELECT CAST(s.range AS INT) AS state, round(v[s.range + 1], 6) AS q FROM q, range(5) s WHERE k = 400""")
def committor_converged(spark, sf_dir):
    return K.to_frame(spark, K.committor(K.dense(_matrix(spark, sf_dir)), [4], [0], 1e-9), "q").select("state", r("q").alias("q"))


@query(f"""WITH RECURSIVE {MATRIX_SQL}, m AS (SELECT list(p ORDER BY i, j) AS a FROM mt), q(k, v) AS (SELECT 0, [0.2, 0.2, 0.2, 0.2, 0.2]::DOUBLE[] UNION ALL
SELECT k + 1, list_transform(range(5), lambda j: list_sum(list_transform(range(5), lambda i: v[i + 1] * a[i * 5 + j + 1])))::DOUBLE[] FROM q, m WHERE k < 100)
SELECT CAST(s.range AS INT) AS state, round(v[s.range + 1], 6) AS p FROM q, range(5) s WHERE k = 100""")
def steady_state(spark, sf_dir):
    return K.to_frame(spark, K.steady_state(K.dense(_matrix(spark, sf_dir))), "p").select("state", r("p").alias("p"))


def kscore(spark, sf_dir):
    return spark.createDataFrame([(round(K.kscore(K.dense(_matrix(spark, sf_dir))), 6),)], "kscore double")


def h_eigs(spark, sf_dir):
    """Eigenvalues of the hermitised matrix, ascending."""
    return K.to_frame(spark, K.hermitian_eigs(K.dense(_matrix(spark, sf_dir)))[0], "eigenvalue").select("state", r("eigenvalue").alias("eigenvalue"))


def motifs(spark, sf_dir):
    w, v = K.hermitian_eigs(K.dense(_matrix(spark, sf_dir)))
    m = K.motifs(v * (v[0].conj() / abs(v[0]))[None, :], 3, w)
    return spark.createDataFrame([(i, [round(float(x), 6) for x in row]) for i, row in enumerate(m)], "state int, motif array<double>")


def kinetic_states(spark, sf_dir):
    w, v = K.hermitian_eigs(K.dense(_matrix(spark, sf_dir)))
    label = K.kinetic_states(K.motifs(v * (v[0].conj() / abs(v[0]))[None, :], 3, w), 2)
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(label)], "state int, kinetic int")


@query(f"WITH {MATRIX_SQL} SELECT DISTINCT i AS state FROM mt")
def clean_clusters(spark, sf_dir):
    """All event types are one weakly connected part."""
    return K.largest_component(_matrix(spark, sf_dir))


for f in (kscore, h_eigs, motifs, kinetic_states):
    QUERIES[f.__name__] = f
