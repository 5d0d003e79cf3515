"""Cells, intensities, masks and contacts from the synthetic pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from motrac.functions import scalar as S
from motrac.operators import cells as C
from motrac.operators import motion as M
from motrac.plans.motion_queries import SHIFT_SQL
from motrac.plans.registry import r, registry
from motrac.sources.fixtures import PIXEL_SQL, pixels

QUERIES, SQL, query = registry()

NEAR_SQL = "nb AS (SELECT p.frame, p.x, p.y, p.label, q.label AS other, (p.x - q.x) ** 2 + (p.y - q.y) ** 2 AS d2 FROM pixels p JOIN pixels q ON p.frame = q.frame AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 WHERE p.label > 0)"
BORDER_SQL = f"{PIXEL_SQL}, {NEAR_SQL}, bo AS (SELECT frame, x, y, label FROM nb WHERE d2 = 1 GROUP BY ALL HAVING count(*) < 4 OR bool_or(other <> label))"
CONTACT_SQL = f"{BORDER_SQL}, cn AS (SELECT nb.frame, nb.x, nb.y, nb.label, min(other) AS contact FROM nb JOIN bo USING (frame, x, y, label) WHERE d2 BETWEEN 1 AND 4 AND other > 0 AND other <> label GROUP BY ALL)"


@query(f"WITH {PIXEL_SQL} SELECT frame, count(DISTINCT nullif(label, 0)) AS n_cells FROM pixels GROUP BY frame")
def frame_counts(spark, sf_dir):
    return C.frame_counts(pixels(spark, sf_dir))


@query(f"""WITH {PIXEL_SQL}, b AS (SELECT frame, label, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, count(*) AS n_pixels FROM pixels WHERE label > 0 GROUP BY ALL)
SELECT row_number() OVER (ORDER BY frame, label) - 1 AS cell_id, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY label) - 1 AS INT) AS ind, label, x0, x1, y0, y1, n_pixels FROM b""")
def cell_index(spark, sf_dir):
    return C.cell_index(pixels(spark, sf_dir))


@query(f"WITH {PIXEL_SQL} SELECT frame, label, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM pixels WHERE label > 0 GROUP BY ALL")
def cell_centers(spark, sf_dir):
    return C.cell_centers(pixels(spark, sf_dir)).select("frame", "label", r("x").alias("x"), r("y").alias("y"))


@query(f"WITH {PIXEL_SQL} SELECT frame, label, count(*) AS size, round(avg(c1), 6) AS c1, round(avg(c2), 6) AS c2 FROM pixels WHERE label > 0 GROUP BY ALL")
def cell_intensities(spark, sf_dir):
    return C.intensities(pixels(spark, sf_dir), ["c1", "c2"], True).select("frame", "label", "size", r("c1").alias("c1"), r("c2").alias("c2"))


@query(f"""WITH {PIXEL_SQL}, b AS (SELECT frame, quantile_cont(c1, 0.05) AS q FROM pixels WHERE label = 0 GROUP BY frame), v AS (SELECT p.frame, label, y % 2 = 0 AS core, c1 - q AS v FROM pixels p JOIN b USING (frame) WHERE label > 0),
s AS (SELECT frame, label, avg(v) FILTER (core) AS a, avg(v) FILTER (NOT core) AS o FROM v GROUP BY ALL) SELECT frame, label, round(a, 6) AS inside, round(o, 6) AS outside, round(a / nullif(o, 0), 6) AS ratio FROM s""")
def compartment_ratio(spark, sf_dir):
    return C.compartment_ratio(pixels(spark, sf_dir), "c1", F.col("y") % 2 == 0, background=5).select("frame", "label", r("inside").alias("inside"), r("outside").alias("outside"), r("ratio").alias("ratio"))


@query(f"WITH {PIXEL_SQL} SELECT frame, label, round(corr(c1, c2), 6) AS corr FROM pixels WHERE label > 0 GROUP BY ALL")
def channel_crosscorr(spark, sf_dir):
    return C.channel_crosscorr(pixels(spark, sf_dir), "c1", "c2").select("frame", "label", r("corr").alias("corr"))


@query(f"WITH {PIXEL_SQL} SELECT frame, x, y, round((c1 - avg(c1) OVER w) / stddev_pop(c1) OVER w, 6) + 0.0 AS z FROM pixels WINDOW w AS (PARTITION BY frame)")
def znorm(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame", "x", "y", r(S.znorm(F.col("c1"), "frame")).alias("z"))


@query(f"WITH {PIXEL_SQL} SELECT frame, x, y, CAST(floor(65535 * (c2 - min(c2) OVER w) / (max(c2) OVER w - min(c2) OVER w)) AS INT) AS v FROM pixels WINDOW w AS (PARTITION BY frame)")
def rescale_to_int(spark, sf_dir):
    return pixels(spark, sf_dir).select("frame", "x", "y", S.rescale_to_int(F.col("c2"), "frame").alias("v"))


@query(f"WITH {PIXEL_SQL}, q AS (SELECT frame, quantile_cont(c2, 0.01) AS a, quantile_cont(c2, 0.99) AS b FROM pixels GROUP BY frame) SELECT frame, x, y, round((c2 - a) / (b - a), 6) + 0.0 AS v FROM pixels JOIN q USING (frame)")
def histogram_stretch(spark, sf_dir):
    return C.histogram_stretch(pixels(spark, sf_dir), "c2").select("frame", "x", "y", r("stretched").alias("v"))


@query(f"WITH {PIXEL_SQL}, f AS (SELECT frame, label, avg(c1) AS m FROM pixels WHERE label > 0 GROUP BY ALL) SELECT frame, x, y, label, round(m, 6) AS feature FROM pixels LEFT JOIN f USING (frame, label)")
def feature_map(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return C.feature_map(px, C.intensities(px, ["c1"], True), "c1").select("frame", "x", "y", "label", r("feature").alias("feature"))


@query(f"""WITH {PIXEL_SQL}, ce AS (SELECT frame, label, avg(x) AS cx, avg(y) AS cy FROM pixels WHERE label > 0 GROUP BY ALL)
SELECT frame, x, y, ce.label FROM pixels p JOIN ce USING (frame) QUALIFY row_number() OVER (PARTITION BY frame, x, y ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), ce.label) = 1""")
def voronoi_assign(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return C.voronoi(px, C.cell_centers(px))


@query(f"""WITH {PIXEL_SQL}, k AS (SELECT frame, label FROM pixels WHERE label > 0 GROUP BY frame, label HAVING count(*) > 30 AND NOT bool_or(x <= 0 OR x >= 31 OR y <= 0 OR y >= 31)), o AS (SELECT frame, label, row_number() OVER (PARTITION BY frame ORDER BY label) AS new_label FROM k)
SELECT frame, x, y, label, CAST(new_label AS INT) AS new_label FROM pixels JOIN o USING (frame, label)""")
def clean_labels(spark, sf_dir):
    return C.clean_labels(pixels(spark, sf_dir), 30, None, (0, 31, 0, 31))


@query(f"WITH {BORDER_SQL} SELECT * FROM bo")
def borders(spark, sf_dir):
    return C.borders(pixels(spark, sf_dir))


@query(f"WITH {CONTACT_SQL} SELECT * FROM cn")
def contact_labels(spark, sf_dir):
    return C.contacts(pixels(spark, sf_dir), 2)


@query(f"WITH {CONTACT_SQL} SELECT frame, label, contact, count(*) AS n FROM cn GROUP BY ALL")
def contact_edges(spark, sf_dir):
    return C.contact_edges(pixels(spark, sf_dir), 2)


@query(f"WITH {CONTACT_SQL}, f AS (SELECT frame, label, avg(c1) AS m FROM pixels WHERE label > 0 GROUP BY ALL) SELECT cn.frame, x, y, cn.label, contact, round(g.m - f.m, 6) + 0.0 AS value FROM cn JOIN f ON cn.frame = f.frame AND cn.label = f.label JOIN f g ON cn.frame = g.frame AND contact = g.label")
def neighbor_feature_map(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return C.neighbour_feature(px, C.intensities(px, ["c1"], True), "c1", 2).select("frame", "x", "y", "label", "contact", r("value").alias("value"))


@query(f"WITH {BORDER_SQL}, s AS (SELECT frame, x, y, label, bool_or(other = 0) AS free FROM nb WHERE d2 = 1 GROUP BY ALL) SELECT bo.*, CASE WHEN free THEN 'cs' ELSE 'cc' END AS kind FROM bo JOIN s USING (frame, x, y, label)")
def cc_cs_border(spark, sf_dir):
    return C.cc_cs_border(pixels(spark, sf_dir))


@query(f"WITH {PIXEL_SQL} SELECT p.frame, p.x, p.y, CASE WHEN any_value(p.label) > 0 THEN any_value(p.label) ELSE max(q.label) END AS label FROM pixels p JOIN pixels q ON p.frame = q.frame AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY ALL")
def dilate_labels(spark, sf_dir):
    return C.dilate(pixels(spark, sf_dir)).select("frame", "x", "y", "label")


@query(f"""WITH RECURSIVE {PIXEL_SQL}, on_px AS (SELECT frame, x, y, CAST(x AS BIGINT) * 1048576 + y AS id FROM pixels WHERE label > 0),
w(frame, x, y, part) AS (SELECT frame, x, y, id FROM on_px UNION SELECT o.frame, o.x, o.y, w.part FROM w JOIN on_px o ON o.frame = w.frame AND o.x BETWEEN w.x - 1 AND w.x + 1 AND o.y BETWEEN w.y - 1 AND w.y + 1)
SELECT frame, x, y, min(part) AS part FROM w GROUP BY ALL""")
def connected_components(spark, sf_dir):
    return C.components(pixels(spark, sf_dir), F.when(F.col("label") > 0, F.lit(1))).select("frame", "x", "y", "part")


@query(f"""WITH RECURSIVE {PIXEL_SQL}, on_px AS (SELECT frame, x, y, label, CAST(x AS BIGINT) * 1048576 + y AS id FROM pixels WHERE label > 0 AND x % 9 <> 0),
w(frame, x, y, label, part) AS (SELECT frame, x, y, label, id FROM on_px UNION SELECT o.frame, o.x, o.y, o.label, w.part FROM w JOIN on_px o ON o.frame = w.frame AND o.label = w.label AND o.x BETWEEN w.x - 1 AND w.x + 1 AND o.y BETWEEN w.y - 1 AND w.y + 1),
p AS (SELECT frame, x, y, label, min(part) AS part FROM w GROUP BY ALL), c AS (SELECT frame, label, part, count(*) AS n FROM p GROUP BY frame, label, part), s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY frame, label ORDER BY n DESC, part) = 1)
SELECT p.frame, x, y, p.label FROM p JOIN s USING (frame, label, part)""")
def label_largestcc(spark, sf_dir):
    return C.largest_parts(pixels(spark, sf_dir).where("x % 9 <> 0"))


@query(f"""WITH {PIXEL_SQL}, s AS (SELECT frame, stddev_pop(c1) AS s FROM pixels GROUP BY frame), m AS (SELECT p.frame, p.x, p.y, any_value(p.c1) AS c1, avg(q.c1) AS m FROM pixels p JOIN pixels q ON p.frame = q.frame AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 GROUP BY p.frame, p.x, p.y)
SELECT m.frame, x, y, c1 > m + 0.5 * s AS "on" FROM m JOIN s USING (frame)""")
def local_threshold(spark, sf_dir):
    return C.local_threshold(pixels(spark, sf_dir), "c1", 3, 0.5).select("frame", "x", "y", "on")


@query(f"WITH {PIXEL_SQL} SELECT frame, x + 4 AS x, y - 4 AS y, label FROM pixels WHERE y - 4 BETWEEN 0 AND 23")
def pad_image(spark, sf_dir):
    return C.pad(pixels(spark, sf_dir), 32, 32, 40, 24).select("frame", "x", "y", "label")


@query(f"WITH {PIXEL_SQL}, q AS (SELECT x + (frame % 3) * 28 AS x, y + (frame // 3) * 28 AS y, frame, c1 FROM pixels) SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, max_by(c1, frame) AS value FROM q GROUP BY ALL")
def slide_mosaic(spark, sf_dir):
    return C.mosaic(pixels(spark, sf_dir), 32, 3, 4).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "value")


@query(f"""WITH {SHIFT_SQL}, b AS (SELECT frame, sx, sy, row_number() OVER (PARTITION BY frame ORDER BY round(cost, 9), sx, sy) AS k FROM co), f AS (SELECT DISTINCT frame FROM ce),
t AS (SELECT frame, sum(coalesce(-sx, 0.0)) OVER w AS tx, sum(coalesce(-sy, 0.0)) OVER w AS ty FROM f LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (frame) WINDOW w AS (ORDER BY frame)) SELECT frame, label, round(x - tx, 6) AS x, round(y - ty, 6) AS y FROM ce JOIN t USING (frame)""")
def registered_positions(spark, sf_dir):
    """Centres less the registration of their frame."""
    px = pixels(spark, sf_dir)
    return C.positions(px, M.stack_shifts(C.cell_centers(px), 4.0, 9)).select("frame", "label", r("x").alias("x"), r("y").alias("y"))
