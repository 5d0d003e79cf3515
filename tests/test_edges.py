"""Empty tables, nulls, ties, repeated rows and clashing columns through the core operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motrac.functions import scalar
from motrac.operators import boundary, cells, embed, features, lineage, markov, motion, stats

PX = "frame int, x int, y int, label int, c1 double, d double, k int"
OBS = "cell_id long, traj_id long, pos int, frame int, x double, y double, state int, parent_id long, dx double, dy double"

PIXELS = {
    "frame_counts": cells.frame_counts,
    "cell_index": cells.cell_index,
    "cell_centers": cells.cell_centers,
    "intensities": lambda p: cells.intensities(p, ["c1"], True),
    "compartment_ratio": lambda p: cells.compartment_ratio(p, "c1", F.col("x") > 1, background=5),
    "channel_crosscorr": lambda p: cells.channel_crosscorr(p, "c1", "d"),
    "histogram_stretch": lambda p: cells.histogram_stretch(p, "c1"),
    "voronoi": lambda p: cells.voronoi(p, cells.cell_centers(p)),
    "clean_labels": lambda p: cells.clean_labels(p, 0, 100),
    "borders": cells.borders,
    "contacts": cells.contacts,
    "cc_cs_border": cells.cc_cs_border,
    "dilate": cells.dilate,
    "components": lambda p: cells.components(p, F.when(F.col("label") > 0, F.col("label"))),
    "largest_parts": cells.largest_parts,
    "local_threshold": lambda p: cells.local_threshold(p, "c1"),
    "bunches": lambda p: cells.bunches(p, F.col("label") > 0, 0),
    "intensity_centers": lambda p: cells.intensity_centers(p, "c1"),
    "border_profile": lambda p: cells.border_profile(p, "c1", 1),
    "best_overlap": lambda p: cells.best_overlap(p, 1),
    "probability_mask": lambda p: cells.probability_mask(p, "c1", 0.5, 2, 1),
    "cell_features": lambda p: features.cell_features(p, "c1", list(features.FEATURES)),
    "stack_shifts": lambda p: motion.stack_shifts(cells.cell_centers(p), 1.0, 3),
    "point_registration": lambda p: motion.point_registration(cells.cell_centers(p)),
    "border_table": boundary.border_table,
    "ligand_density": boundary.ligand_density,
    "assignment_links": lambda p: lineage.assignment_links(cells.cell_centers(p), 3.0),
}
CELLS = {
    "nearest_links": lineage.nearest_links,
    "parents": lineage.parents,
    "ancestors": lambda o: lineage.ancestors(o, o),
    "unique_trajectories": lambda o: lineage.unique_trajectories(o, 1),
    "segments": lambda o: lineage.segments(o, 2),
    "displacements": lambda o: motion.displacements(o.drop("dx", "dy")),
    "alignments": lambda o: motion.alignments(o, 5.0),
    "motility": lambda o: motion.motility(o, 5.0),
    "tcf": motion.tcf,
    "msd": motion.msd,
    "dx_tcf": motion.dx_tcf,
    "pair_cluster_rdf": lambda o: motion.pair_cluster_rdf(o, "state", 10.0, 5),
    "dx_rdf": lambda o: motion.dx_rdf(o, 10.0, 5),
    "dx_theta": lambda o: motion.dx_theta(o, 10.0, 5),
    "dx_alpha": lambda o: motion.dx_alpha(o, 10.0, 5),
    "signal_contributions": lambda o: motion.signal_contributions(o, "state"),
    "centred_mean": lambda o: motion.centred_mean(o, "x", 2),
    "state_steps": markov.state_steps,
    "histogram": lambda o: stats.histogram(o, "x", 0.0, 10.0, 5),
    "mesh_average": lambda o: stats.mesh_average(o, "x", "x", "y", 2.0),
    "flux_ligdist": lambda o: scalar.flux_ligdist(o, F.col("x")),
    "prefix_sum": lambda o: stats.prefix_sum(o, "x", ["cell_id"], "s"),
}


@pytest.mark.parametrize("name", sorted(PIXELS))
def test_no_pixels(spark, name):
    assert PIXELS[name](spark.createDataFrame([], PX)).count() == 0


@pytest.mark.parametrize("name", sorted(CELLS))
def test_no_cells(spark, name):
    assert CELLS[name](spark.createDataFrame([], OBS)).count() == 0


def _pixels(spark, fill):
    """Two frames with two touching cells; one pixel's label and another's value is fill."""
    rows = [(f, x, y, 1 + (x > 2) if 0 < x < 5 and 0 < y < 3 else 0, float(x * y), 1.0, 0) for f in (0, 1) for x in range(6) for y in range(4)]
    rows = [(f, x, y, fill if (x, y) == (0, 3) else lab, None if (x, y) == (1, 1) else c, d, k) for f, x, y, lab, c, d, k in rows]
    return spark.createDataFrame(rows, PX)


@pytest.mark.parametrize("name", sorted(set(PIXELS) - {"border_table", "dilate", "voronoi"}))
def test_null_labels_are_background_and_null_values_do_no_harm(spark, name):
    """The same rows whether a background pixel's label is zero or null."""
    zero, null = (sorted(map(str, PIXELS[name](_pixels(spark, fill)).drop("label" if name in ("histogram_stretch", "local_threshold") else "none").collect())) for fill in (0, None))
    assert zero == null and zero


def test_null_places_and_states_do_no_harm(spark):
    rows = [(i, 1, i, i, float(i), 0.0, 1, i - 1 if i else None, 1.0 if i else None, 0.0 if i else None) for i in range(6)]
    rows += [(10, 2, 0, None, None, None, None, None, None, None), (11, 2, 1, 3, 1.0, None, None, 10, None, None)]
    o = spark.createDataFrame(rows, OBS)
    for name, f in CELLS.items():
        assert f(o).collect() is not None, name
    assert {(r["i"], r["j"]) for r in markov.state_steps(o).collect()} == {(1, 1)}
    links = {r["cell_id"]: r["parent_id"] for r in lineage.nearest_links(o).collect()}
    assert len(links) == 8 and links[10] is None and links[3] == 2


def test_ties_go_to_the_smaller_number(spark):
    o = spark.createDataFrame([(5, 0, 0.0, 1.0), (3, 0, 0.0, -1.0), (9, 1, 0.0, 0.0)], "cell_id long, frame int, x double, y double")
    assert {r["cell_id"]: r["parent_id"] for r in lineage.nearest_links(o).collect()}[9] == 3
    centers = spark.createDataFrame([(2, [1.0]), (1, [-1.0])], "cluster int, center array<double>")
    assert embed.assign(spark.createDataFrame([(0, [0.0])], "cell_id long, xf array<double>"), centers).first()["cluster"] == 1


def test_markov_of_nothing(spark):
    none = spark.createDataFrame([], "traj_id long, pos int, i int, j int")
    m = markov.transition_matrix(none, 3)
    assert sorted(tuple(r) for r in m.collect()) == [(i, j, float(i == j)) for i in range(3) for j in range(3)]
    assert markov.path_entropy(none, m).first()["entropy"] is None and markov.path_ll(none, m).first()["ll"] is None
    assert markov.traj_gmean(none, m).count() == 0 and markov.entropy_production(none, m).first()["entropy_production"] is None
    assert np.allclose(markov.steady_state(np.eye(2)), 0.5)


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None)], "g int, v double")
    z = df.select("g", scalar.znorm(F.col("v"), "g").alias("z"), scalar.rescale_to_int(F.col("v"), "g").alias("k")).collect()
    assert [r["z"] for r in z] == [None] * 3 and [r["k"] for r in z] == [None] * 3
    pairs = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 5.0), (2, 1.0, 3.0), (2, 2.0, 1.0), (2, None, 9.0), (3, None, None)], "g int, a double, b double")
    got = {r["g"]: r["c"] for r in pairs.groupBy("g").agg(scalar.correlation(F.col("a"), F.col("b")).alias("c")).collect()}
    assert got[1] is None and got[3] is None and got[2] == pytest.approx(-1)
    assert stats.linear_coef(pairs, F.col("b"), F.col("a"), 2 * F.col("a")).first()["ca"] is None
    levels = stats.credible_level(spark.createDataFrame([(1, 0), (2, 0)], "bin int, n int"), "n").collect()
    assert [r["level"] for r in levels] == [None, None]
    far = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 1, 50.0, 0.0)], "cell_id long, frame int, x double, y double")
    assert {(r["n"], r["g"]) for r in motion.pair_rdf(far, far, 10.0, 4).collect()} == {(0, None)}
