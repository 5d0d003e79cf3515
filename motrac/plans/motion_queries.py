"""Displacements, correlations, pair distributions, forces and registration."""

from __future__ import annotations

from pyspark.sql import functions as F

from motrac.functions import scalar as S
from motrac.operators import cells as C
from motrac.operators import motion as M
from motrac.plans.registry import r, r_signed, registry
from motrac.sources.fixtures import OBS_SQL, PIXEL_SQL, observations, pixels

QUERIES, SQL, query = registry()

MOVE_SQL = f"{OBS_SQL}, mv AS (SELECT a.*, a.x - b.x AS dx, a.y - b.y AS dy FROM obs a LEFT JOIN obs b ON a.parent_id = b.cell_id)"
PAIR_SQL = f"""{MOVE_SQL}, pr AS (SELECT a.frame, a.cell_id, b.cell_id AS b_cell_id, a.x, a.y, b.x AS bx, b.y AS byy, a.dx, a.dy, b.dx AS bdx, b.dy AS bdy, a.state, b.state AS bstate,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM mv a JOIN mv b ON a.frame = b.frame)"""
ALIGN_SQL = f"""{PAIR_SQL}, u AS (SELECT *, nullif(sqrt(dx * dx + dy * dy), 0) AS n, nullif(sqrt(bdx * bdx + bdy * bdy), 0) AS bn FROM pr WHERE cell_id <> b_cell_id AND d > 0 AND d < 15),
al AS (SELECT cell_id, b_cell_id, d, (dx / n - bdx / bn) * ((x - bx) / d) + (dy / n - bdy / bn) * ((y - byy) / d) AS alpha, dx / n * bdx / bn + dy / n * bdy / bn AS beta FROM u)"""
LAG_SQL = """, ln AS (SELECT traj_id, count(*) AS n FROM obs GROUP BY traj_id)"""


def _moving(spark, sf_dir):
    return M.displacements(observations(spark, sf_dir))


@query(f"WITH {MOVE_SQL} SELECT cell_id, round(dx, 6) AS dx, round(dy, 6) AS dy FROM mv")
def dx(spark, sf_dir):
    return _moving(spark, sf_dir).select("cell_id", r("dx").alias("dx"), r("dy").alias("dy"))


@query(f"WITH {ALIGN_SQL} SELECT cell_id, b_cell_id, round(alpha, 6) + 0.0 AS alpha, round(beta, 6) + 0.0 AS beta FROM al")
def alpha_beta(spark, sf_dir):
    pairs = M.alignments(_moving(spark, sf_dir), 15.0, ("cell_id", "b_cell_id", "alpha", "beta"))
    return pairs.select("cell_id", "b_cell_id", r_signed("alpha").alias("alpha"), r_signed("beta").alias("beta"))


@query(f"""WITH {ALIGN_SQL}, g AS (SELECT cell_id, avg(alpha) AS a, avg(beta) AS b FROM al GROUP BY cell_id)
SELECT mv.cell_id, round(sqrt(dx * dx + dy * dy), 6) AS speed, CASE WHEN dx IS NOT NULL THEN round(coalesce(a, 0), 6) + 0.0 END AS alpha, CASE WHEN dx IS NOT NULL THEN round(coalesce(b, 0), 6) + 0.0 END AS beta FROM mv LEFT JOIN g USING (cell_id)""")
def motility(spark, sf_dir):
    return M.motility(_moving(spark, sf_dir), 15.0).select("cell_id", r("speed").alias("speed"), r("alpha").alias("alpha"), r("beta").alias("beta"))


def _lag_sql(value: str, least: int, source: str = "obs") -> str:
    return f"""WITH {MOVE_SQL}{LAG_SQL}, p AS (SELECT b.pos - a.pos AS lag, {value} AS v FROM {source} a JOIN ln USING (traj_id) JOIN {source} b ON a.traj_id = b.traj_id AND b.pos BETWEEN a.pos AND a.pos + n // 2 - 1 WHERE n > {least} AND a.pos < n // 2)
SELECT lag, round(avg(v), 4) AS value, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY lag"""


@query(_lag_sql("a.x * b.x + a.y * b.y", 2))
def tcf(spark, sf_dir):
    return M.tcf(observations(spark, sf_dir)).select("lag", r("value", 4).alias("value"), "n")


@query(_lag_sql("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)", 1))
def msd(spark, sf_dir):
    return M.msd(observations(spark, sf_dir)).select("lag", r("value", 4).alias("value"), "n")


@query(_lag_sql("a.dx * b.dx + a.dy * b.dy", 1, "mv"))
def dx_tcf(spark, sf_dir):
    return M.dx_tcf(_moving(spark, sf_dir)).select("lag", r("value", 4).alias("value"), "n")


def _edge_sql(low: float, high: float, n: int) -> str:
    return f"(SELECT range AS k, {low!r} + ({high!r} - {low!r}) * range / {n - 1} AS e FROM range({n}))"


@query(f"""WITH {PAIR_SQL}, e AS {_edge_sql(1e-6, 50.0, 11)}, b AS (SELECT a.k, a.e, 2 * pi() * a.e * (a.e - p.e) AS vol, p.e AS lo FROM e a JOIN e p ON a.k = p.k + 1),
h AS (SELECT k, any_value(e) AS e, any_value(vol) AS vol, count(pr.d) AS n FROM b LEFT JOIN pr ON pr.d >= lo AND pr.d < e AND pr.d < 50 GROUP BY k)
SELECT CAST(k AS INT) AS bin, round(e, 6) AS r, n, round(n / vol * sum(vol) OVER () / sum(n) OVER (), 6) AS g FROM h""")
def pair_rdf(spark, sf_dir):
    o = observations(spark, sf_dir)
    return M.pair_rdf(o, o, 50.0, 11).select("bin", r("r").alias("r"), "n", r("g").alias("g"))


@query(f"""WITH {PAIR_SQL}, e AS {_edge_sql(1e-6, 50.0, 11)}, q AS (SELECT (SELECT count(*) FROM e WHERE e.e <= pr.d) AS bin, state, bstate FROM pr WHERE d < 50)
SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(avg(CAST(state = bstate AS DOUBLE)), 6) AS share FROM q WHERE bin BETWEEN 1 AND 10 GROUP BY bin""")
def pair_cluster_rdf(spark, sf_dir):
    return M.pair_cluster_rdf(observations(spark, sf_dir), "state", 50.0, 11).select("bin", "n", r("share").alias("share"))


@query(f"""WITH {PAIR_SQL}, q AS (SELECT frame, CAST(floor(d / 8.0) AS INT) + 1 AS bin, dx * bdx + dy * bdy AS v FROM pr WHERE d < 40 AND dx IS NOT NULL AND bdx IS NOT NULL), f AS (SELECT bin, frame, avg(v) AS v FROM q GROUP BY ALL)
SELECT bin, round(avg(v), 4) AS value, count(*) AS n_frames FROM f GROUP BY bin""")
def dx_rdf(spark, sf_dir):
    return M.dx_rdf(_moving(spark, sf_dir), 40.0, 6).select("bin", r("value", 4).alias("value"), "n_frames")


@query(f"""WITH {PAIR_SQL}, t AS (SELECT acos(greatest(-1.0, least(1.0, (dx * bdx + dy * bdy) / sqrt(dx * dx + dy * dy) / sqrt(bdx * bdx + bdy * bdy)))) AS th FROM pr WHERE d < 40 AND cell_id > b_cell_id AND (dx <> 0 OR dy <> 0) AND (bdx <> 0 OR bdy <> 0)),
h AS (SELECT CAST(floor(th / (pi() / 9)) AS INT) + 1 AS bin, count(*) AS n FROM t WHERE th < pi() GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM h""")
def dx_theta(spark, sf_dir):
    return M.dx_theta(_moving(spark, sf_dir), 40.0, 10).select("bin", "n", r("share").alias("share"))


@query(f"""WITH {ALIGN_SQL}, h AS (SELECT CAST(floor((alpha + 2) / (4.0 / 9)) AS INT) + 1 AS bin, count(*) AS n FROM al WHERE alpha < 2 GROUP BY 1) SELECT bin, n, round(n / sum(n) OVER (), 6) AS share FROM h""")
def dx_alpha(spark, sf_dir):
    return M.dx_alpha(_moving(spark, sf_dir), 15.0, 10).select("bin", "n", r("share").alias("share"))


@query(f"""WITH {PAIR_SQL} SELECT cell_id, round(sum(bstate / (d / 2.0)), 6) AS received, count(*) AS n FROM pr WHERE d > 0 AND d < 20 GROUP BY cell_id""")
def signal_contributions(spark, sf_dir):
    return M.signal_contributions(observations(spark, sf_dir), "state", 10.0, 2.0).select("cell_id", r("received").alias("received"), "n")


CENTER_SQL = f"{PIXEL_SQL}, ce AS (SELECT frame, label, avg(x) AS x, avg(y) AS y FROM pixels WHERE label > 0 GROUP BY ALL)"
SHIFT_SQL = f"""{CENTER_SQL}, g AS (SELECT -4.0 + 8.0 * a.range / 8 AS sx, -4.0 + 8.0 * b.range / 8 AS sy FROM range(9) a, range(9) b),
p AS (SELECT n.frame, sx, sy, n.label AS l1, q.label AS l0, sqrt((q.x + sx - n.x) ** 2 + (q.y + sy - n.y) ** 2) AS d FROM ce n JOIN ce q ON n.frame = q.frame + 1, g),
co AS (SELECT frame, sx, sy, sum(m) AS cost FROM (SELECT frame, sx, sy, l1, min(d) AS m FROM p GROUP BY ALL UNION ALL SELECT frame, sx, sy, l0, min(d) FROM p GROUP BY ALL) GROUP BY ALL)"""


@query(f"WITH {SHIFT_SQL} SELECT frame, sx, sy, round(cost, 6) AS cost FROM co")
def pairwise_distance_sum(spark, sf_dir):
    return M.shift_costs(C.cell_centers(pixels(spark, sf_dir)), 4.0, 9).select("frame", "sx", "sy", r("cost").alias("cost"))


@query(f"""WITH {SHIFT_SQL}, b AS (SELECT frame, sx, sy, row_number() OVER (PARTITION BY frame ORDER BY round(cost, 9), sx, sy) AS k FROM co), f AS (SELECT DISTINCT frame FROM ce)
SELECT frame, sum(coalesce(-sx, 0.0)) OVER w + 0.0 AS tx, sum(coalesce(-sy, 0.0)) OVER w + 0.0 AS ty FROM f LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (frame) WINDOW w AS (ORDER BY frame)""")
def stack_trans(spark, sf_dir):
    return M.stack_shifts(C.cell_centers(pixels(spark, sf_dir)), 4.0, 9).select("frame", r("tx").alias("tx"), r("ty").alias("ty"))


def _force(expr):
    def run(spark, sf_dir):
        return observations(spark, sf_dir).select("cell_id", (F.col("y") / 20 + 0.3).alias("rr")).select("cell_id", r(expr(F.col("rr"))).alias("v"))

    return run


QUERIES["dist_to_contact"] = _force(lambda v: S.dist_to_contact(v, 2.0, 1.0))
SQL["dist_to_contact"] = f"WITH {OBS_SQL}, q AS (SELECT cell_id, y / 20 + 0.3 AS rr FROM obs) SELECT cell_id, round(CASE WHEN rr < 1 THEN 1.0 ELSE (1 - ((rr - 1) / 2.0) ** 6) / (1 - ((rr - 1) / 2.0) ** 12) END, 6) + 0.0 AS v FROM q"
QUERIES["yukawa_force"] = _force(lambda v: S.yukawa_force(v, 2.0, 1.5))
SQL["yukawa_force"] = f"WITH {OBS_SQL}, q AS (SELECT cell_id, y / 20 + 0.3 AS rr FROM obs) SELECT cell_id, round(2.0 * exp(-rr / 1.5) * (rr + 1.5) / (1.5 * rr * rr), 6) AS v FROM q"
QUERIES["lj_force"] = _force(lambda v: S.lj_force(v, 0.5, 1.2))
SQL["lj_force"] = f"WITH {OBS_SQL}, q AS (SELECT cell_id, greatest(y / 20 + 0.3, 1.2 / 2 ** (1.0 / 6)) AS rr, 1.2 / 2 ** (1.0 / 6) AS s FROM obs) SELECT cell_id, round(24.0 * (s ** 12 / rr ** 13 - 0.5 * s ** 6 / rr ** 7), 6) + 0.0 AS v FROM q"
QUERIES["morse_force"] = _force(lambda v: S.morse_force(v, 1.5, 1.0, 4.0))
SQL["morse_force"] = f"WITH {OBS_SQL}, q AS (SELECT cell_id, y / 20 + 0.3 AS rr FROM obs) SELECT cell_id, round(1.5 * (exp(-2 * (rr - 1) / 4) - exp((rr - 1) / 4)), 6) + 0.0 AS v FROM q"


@query(f"WITH {OBS_SQL} SELECT cell_id, round(2.0 * x - avg(2.0 * x) OVER (), 5) + 0.0 AS mean, round(abs(0.5 * x), 6) AS sigma FROM obs")
def flux_ligdist(spark, sf_dir):
    flux = S.flux_ligdist(observations(spark, sf_dir).select("cell_id", "x"), F.col("x"), 2.0, 0.5)
    return flux.select("cell_id", r("mean", 5).alias("mean"), r("sigma").alias("sigma"))


@query(f"WITH {OBS_SQL}, q AS (SELECT cell_id, x AS a, y AS b, CAST(state AS DOUBLE) AS c, CASE WHEN x + y + state = 0 THEN 1.0 ELSE x + y + state END AS t FROM obs) SELECT cell_id, round(0.5 * (2 * b + c) / t, 6) AS u, round(sqrt(3.0) / 2 * c / t, 6) AS v FROM q")
def ternary_coords(spark, sf_dir):
    u, v = S.ternary_coords(F.col("x"), F.col("y"), F.col("state").cast("double"))
    return observations(spark, sf_dir).select("cell_id", r(u).alias("u"), r(v).alias("v"))


@query("SELECT event_id AS cell_id, day(ts) * 86400 + hour(ts) * 3600 + minute(ts) * 60 AS seconds FROM events")
def time_parse(spark, sf_dir):
    from motrac.sources.fixtures import table

    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("img_"), F.date_format("ts", "dd'd'HH'h'mm'm'"), F.lit(".tif"))
    return e.select(F.col("event_id").alias("cell_id"), S.time_stamp_seconds(name).cast("long").alias("seconds"))


@query("SELECT event_id AS cell_id, CAST(event_id % 100 AS INT) AS fov, row_number() OVER (ORDER BY event_id % 100, event_id) AS k FROM events")
def fov_sort(spark, sf_dir):
    """Files by their field of view; the order as a number, from per-field counts and places, so no task sorts everything."""
    from pyspark.sql import Window

    from motrac.sources.fixtures import table

    name = F.concat(F.lit("fov_"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("_.tif"))
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("cell_id"), S.fov_number(name, 4).alias("fov"))
    sizes = f.groupBy("fov").agg(F.count("*").alias("n"))
    first = sizes.select("fov", F.coalesce(F.sum("n").over(Window.orderBy("fov").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return f.withColumn("k", F.row_number().over(Window.partitionBy("fov").orderBy("cell_id"))).join(F.broadcast(first), "fov").select("cell_id", "fov", (F.col("first") + F.col("k")).alias("k"))


@query("SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, CAST((3 - a.range) * 5 + CASE WHEN (3 - a.range) % 2 = 1 THEN 4 - b.range ELSE b.range END AS INT) AS tile, CAST(CASE WHEN a.range % 2 = 1 THEN a.range ELSE a.range + 1 END AS BIGINT) AS odd FROM range(4) a, range(5) b")
def tile_order(spark, sf_dir):
    grid = spark.range(20).select((F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).cast("int").alias("j"))
    return grid.select("i", "j", S.tile_index(F.col("i"), F.col("j"), 4, 5, True).alias("tile"), S.make_odd(F.col("i")).alias("odd"))


@query("SELECT CAST(range AS INT) AS k, round(2 * cos(range * 0.1), 6) AS m00, round(10 - 2 * cos(range * 0.1) * 10 + 2 * sin(range * 0.1) * 5 + range, 6) + 0.0 AS m02 FROM range(12)")
def tf_matrix_2d(spark, sf_dir):
    m = S.affine_2d(F.col("id") * 0.1, F.col("id").cast("double"), F.lit(0.0), 10.0, 5.0, 2.0)
    return spark.range(12).select(F.col("id").cast("int").alias("k"), r(m[0]).alias("m00"), r(m[2]).alias("m02"))
