"""Pairs of cells that are not moved, and blocks that are not written."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motrac.operators import embed as E
from motrac.operators import motion as M
from motrac.plans import catalog


def _moving(spark, n=60):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.uniform(0, 9), rng.choice([float(rng.randrange(-7, 9)), rng.uniform(-7, 9)]), *(rng.choice([(None, None), (0.0, 0.0), (rng.uniform(-1, 1), rng.uniform(-1, 1))]))) for i in range(n)]
    rows += [(n, 0, rows[0][2], rows[0][3], 1.0, 1.0), (n + 1, 0, None, None, 1.0, 1.0), (n + 2, 9, 0.0, 0.0, 1.0, 0.0)]
    return spark.createDataFrame(rows, "cell_id long, frame int, x double, y double, dx double, dy double")


def test_near_motility_equals_contacts(spark):
    m = _moving(spark)
    o = m.select(F.col("cell_id").alias("other_id"), "frame", F.col("y").alias("b"))
    contacts = m.join(o, "frame").where("cell_id <> other_id and abs(y - b) <= 2").select("cell_id", "other_id", (1 + F.col("cell_id") % 3).alias("n"))
    want, got = ({r[0]: r[1:] for r in d.collect()} for d in (M.contact_motility(m, contacts), M.near_motility(m, "y", 2.0, 1 + F.col("cell_id") % 3)))
    assert set(got) == set(want) and len(got) == m.count()
    for k, v in want.items():
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got[k], v)), k


def test_pairs_of_contact_motility_are_not_moved(spark, sf_dir):
    """What is shuffled knows one cell; before, both numbers of each pair were."""
    plan = catalog.queries()["contact_motility"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("other_id" in line for line in plan.split("\n") if "Exchange" in line)
    assert "other_id" not in plan


def test_pairs_of_blocks_are_not_written(spark):
    """Sides are written, their product is not; before, each pair of blocks was shuffled."""
    p = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "cell_id long, xf array<double>")
    plan = E.distance_rows(p, p, block=8)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
    near = E.knn(p, p, 3, itself=True, block=8).collect()
    assert sorted((r["i"], r["rank"], r["j"]) for r in near) == [(i, k + 1, j) for i in range(40) for k, j in enumerate(sorted(range(40), key=lambda j: (abs(i - j), j))[:3])]


@pytest.mark.parametrize("parts", [1, 2])
def test_sparse_diffusion_map_equals_dense(parts, monkeypatch):
    """Leading vectors from products alone, without the matrix; two parts that do not meet have the eigenvalue one twice."""
    rng = np.random.default_rng(parts)
    n, own = 1200, 1200 // parts
    i = np.repeat(np.arange(n), 8)
    j = i // own * own + (i % own + np.tile([0, 1, 2, 3, -1, -2, 40, 300], n)) % own
    p = rng.random(len(i)) + 0.1
    p /= np.bincount(i, p)[i]
    dense = np.zeros((n, n))
    np.add.at(dense, (i, j), p)
    w, v = E._leading(lambda x: np.stack([np.bincount(i, p * c[j], n) for c in x.T], axis=1), n, 4)
    assert np.allclose(dense @ v, v * w, atol=1e-8) and np.allclose(w.real, np.sort(np.linalg.eigvals(dense).real)[::-1][:4], atol=1e-8)
    if parts == 1:
        want = np.abs(E.diffusion_map(dense, 1))
        monkeypatch.setattr(E, "diffusion_map", None)
        assert np.allclose(np.abs(E.sparse_diffusion_map(i, j, p, n, 1)), want, atol=1e-6)


def test_closeness_needs_no_transport(spark, sf_dir):
    """The columns asked for and no others are made: no cloud goes to Python; before, all were moved for closeness too."""
    assert "Cogroup" not in catalog.queries()["library_closeness"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().replace("CoGroup", "Cogroup")
    assert "Cogroup" in catalog.queries()["library_properties"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString().replace("CoGroup", "Cogroup")


def test_only_what_pairs_need_is_sent_to_nine_places(spark, sf_dir):
    """Before, every column of both cells went along, and the windows under them ran once a side."""
    plan = catalog.queries()["alpha_beta"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not any(c in plan for c in ("traj_id", "parent_id", "state"))


def _near(rows, rmax):
    out = {}
    for a in rows:
        for b in rows:
            if a["cell_id"] != b["cell_id"] and a["frame"] == b["frame"] and None not in (a["x"], a["y"], b["x"], b["y"]) and 0 < (d := np.hypot(a["x"] - b["x"], a["y"] - b["y"])) < rmax:
                n, m = ((c["dx"] is not None and np.hypot(c["dx"], c["dy"])) or None for c in (a, b))
                u, v = ([c["dx"] / k, c["dy"] / k] if k else None for c, k in ((a, n), (b, m)))
                both = u and v
                out[a["cell_id"], b["cell_id"]] = (a["frame"], d, both and ((u[0] - v[0]) * (a["x"] - b["x"]) + (u[1] - v[1]) * (a["y"] - b["y"])) / d, both and u[0] * v[0] + u[1] * v[1])
    return out


@pytest.mark.parametrize("own", [65536, 3])
def test_tiles_miss_no_pair(spark, monkeypatch, own):
    """Pairs within tiles and over their edges, once each, in tiles whole or in parts. Rows go to few tiles; before, each went to nine places."""
    monkeypatch.setattr(M, "OWN", own)
    monkeypatch.setattr(M, "STEP", 4)
    monkeypatch.setattr(M, "OTHERS", 5)
    m = _moving(spark, 150).withColumn("x", F.col("x") * 9 - 20).withColumn("y", F.col("y") * 3)
    got = M.alignments(m, 4.0).collect()
    want = _near(m.collect(), 4.0)
    assert len(got) == len(want) > 100 and {(r["cell_id"], r["b_cell_id"]) for r in got} == set(want)
    for g in got:
        frame, *numbers = want[g["cell_id"], g["b_cell_id"]]
        assert g["frame"] == frame
        for a, b in zip((g["d"], g["alpha"], g["beta"]), numbers):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, abs=1e-12))
    placed = M._unit(m).where("x is not null and y is not null")
    sent = M._sent(placed, 4.0)
    assert sent.where("own").count() == placed.count() and (own == 3 or sent.count() < 2 * placed.count())


def test_pairs_are_made_where_their_rows_are(spark, sf_dir):
    plan = catalog.queries()["alpha_beta"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_signed_rounding_equals_plain(spark):
    from motrac.plans.registry import r, r_signed

    rows = [(v,) for v in (None, float("nan"), -0.0, 0.0, 1.2345678, -1.2345678, -1e-9, 2e9, -2e9, 0.1234565, -0.5)]
    got = spark.createDataFrame(rows, "v double").select(r("v").alias("a"), r_signed("v").alias("b")).collect()
    assert [str(g["a"]) for g in got] == [str(g["b"]) for g in got]
