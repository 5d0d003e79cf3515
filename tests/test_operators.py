"""Small cases worked by hand, and invariants."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motrac.operators import boundary as B
from motrac.operators import embed as E
from motrac.operators import features as X
from motrac.operators import koopman as Q
from motrac.operators import lineage as L
from motrac.operators import markov as K
from motrac.operators import motion as M
from motrac.operators import stats as T


def _series(spark, rows):
    return spark.createDataFrame([(t, p, s) for t, states in rows.items() for p, s in enumerate(states)], "traj_id long, pos int, state int")


def test_transition_matrix_micro(spark):
    steps = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (2, 0)], "i int, j int")
    p = {(r["i"], r["j"]): r["p"] for r in K.transition_matrix(steps, 4).collect()}
    assert p[0, 1] == 1 and p[1, 1] == p[1, 2] == 0.5 and p[2, 0] == 1 and p[3, 3] == 1 and sum(p.values()) == 4
    m = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9), (0, 2, 0.0), (1, 0, 0.5), (1, 1, 0.5), (1, 2, 0.0), (2, 0, 0.3), (2, 1, 0.0), (2, 2, 0.7)], "i int, j int, p double")
    want = np.mean([-math.log(0.9), -math.log(0.5), -math.log(0.3)])
    assert K.path_entropy(steps, m).first()[0] == pytest.approx(want) and round(want, 6) == 0.667494
    assert K.path_entropy(steps.limit(0), m).first()[0] is None


def test_markov_spectra():
    assert K.steady_state(np.array([[0.1, 0.9], [0.5, 0.5]]), 1e-12) == pytest.approx([5 / 14, 9 / 14])
    assert K.committor(np.array([[0.8, 0.2], [0.1, 0.9]]), [1], [0]).tolist() == [0, 1]
    assert K.kscore(np.array([[0.9, 0.1], [0.05, 0.95]])) == pytest.approx(1 / 0.15)
    assert math.isnan(K.kscore(np.array([[1.0, 0.0], [0.0, 1.0]])))
    m = np.array([[0.5, 0.5, 0], [0.25, 0.5, 0.25], [0, 0.5, 0.5]])
    q = K.committor(m, [2], [0], 1e-12)
    assert q == pytest.approx([0, 0.5, 1])
    w, v = K.hermitian_eigs(m)
    h = (m + m.T) / 2 + 0.5j * (m - m.T)
    assert np.allclose(v @ np.diag(w) @ v.conj().T, h) and (np.diff(w) >= 0).all()
    assert K.motifs(v, 2).shape == (3, 4)
    x = np.concatenate([np.zeros((10, 2)), np.full((10, 2), 5.0)]) + np.random.default_rng(0).normal(size=(20, 2)) * 0.1
    label = K.kinetic_states(x, 2)
    assert len(set(label[:10])) == len(set(label[10:])) == 1 and label[0] != label[-1]


def test_largest_component(spark):
    m = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 2, 1.0), (5, 5, 1.0)], "i int, j int, p double")
    assert sorted(r[0] for r in K.largest_component(m).collect()) == [2, 3, 4]


def test_ab_runs(spark):
    s = _series(spark, {1: [0, 2, 2, 4, 0, 4, 2, 0, 3, 0, 1, 4], 2: [2, 2], 3: [0, 0, 1], 4: [0, 4]})
    got = sorted(tuple(r) for r in L.ab_runs(s, 0, 4).collect())
    assert got == [(1, 0, 4), (1, 9, 12)]
    direct = sorted(tuple(r) for r in L.ab_runs(s, 0, 4, include_direct=True).collect())
    assert (4, 0, 2) in direct and (1, 0, 6) in direct
    assert sorted(tuple(r) for r in L.ab_runs(s, 0).collect())[:2] == [(1, 0, 1), (1, 4, 5)]


def _greedy(parent, extra):
    left, covered, out = set(parent), set(), []
    while left:
        c = max(left)
        chain = [c]
        while parent[chain[0]] is not None:
            chain.insert(0, parent[chain[0]])
        hit = [i for i, x in enumerate(chain) if x in covered]
        if hit:
            chain = chain[max(0, hit[-1] + 1 - extra) :]
        out.append((c, tuple(chain)))
        covered |= set(chain)
        left -= set(chain)
    return sorted(out)


def test_unique_trajectories_is_the_greedy_cover(spark):
    rng = random.Random(1)
    parent = {i: (rng.randrange(max(0, i - 6), i) if i and rng.random() < 0.9 else None) for i in range(60)}
    cells = spark.createDataFrame(list(parent.items()), "cell_id long, parent_id long")
    for extra in (0, 2):
        rows = L.unique_trajectories(cells, extra).collect()
        got = sorted((o, tuple(r["cell_id"] for r in sorted(g, key=lambda r: r["pos"]))) for o, g in itertools.groupby(sorted(rows, key=lambda r: r["owner"]), key=lambda r: r["owner"]))
        assert got == _greedy(parent, extra)


def test_pairs_within_loses_none(spark):
    rng = np.random.default_rng(2)
    pts = [(i, int(i % 3), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-20, 20, (150, 2)))]
    df = spark.createDataFrame(pts, "cell_id long, frame int, x double, y double")
    got = sorted((r["cell_id"], r["b_cell_id"]) for r in L.pairs_within(df, df, 4.0, [("frame", "frame")]).collect())
    want = sorted((a[0], b[0]) for a in pts for b in pts if a[1] == b[1] and math.dist(a[2:], b[2:]) < 4)
    assert got == want


def test_registration_finds_the_shift(spark):
    base = [(3.0, 4.0), (10.0, 2.0), (7.0, 12.0), (15.0, 9.0)]
    rows = [(0, x, y) for x, y in base] + [(1, x + 2, y - 1) for x, y in base]
    got = {r["frame"]: (r["tx"], r["ty"]) for r in M.stack_shifts(spark.createDataFrame(rows, "frame int, x double, y double"), 4.0, 9).collect()}
    assert got == {0: (0.0, 0.0), 1: (-2.0, 1.0)}


def test_nulls_and_empty(spark):
    cells = spark.createDataFrame([(1, 0, 1.0, None), (2, 1, None, 3.0), (3, 1, 1.0, 1.0)], "cell_id long, frame int, x double, y double")
    assert L.nearest_links(cells, 5.0).count() == 3
    assert M.msd(spark.createDataFrame([], "traj_id long, pos int, x double, y double")).count() == 0


def test_batch_normalization_recovers_a_line(spark):
    v = spark.range(20000).select((F.randn(1) * 3 + 10).alias("v"))
    a, b = T.batch_normalization(v.select((F.col("v") * 2 + 5).alias("v")), v)
    assert a == pytest.approx(2, abs=0.1) and b == pytest.approx(5, abs=1)


def test_decomposition_recovers_truth(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(size=(6, 2))
    probs = pd.DataFrame(p / p.sum(1, keepdims=True), index=[f"c{i}" for i in range(6)], columns=["s0", "s1"])
    truth = {"g0": (1.0, 2.0), "g1": (0.0, 3.0)}
    rows = [(c, g, float(probs.loc[c] @ np.array(t))) for c in probs.index for g, t in truth.items()]
    got = {(r["gene"], r["state"]): r["fc"] for r in T.state_decomposition(spark.createDataFrame(rows, "condition string, gene string, fc double"), probs).collect()}
    for g, t in truth.items():
        assert (got[g, "s0"], got[g, "s1"]) == pytest.approx(t, abs=1e-5)
    with pytest.raises(ValueError):
        T.state_decomposition(spark.createDataFrame(rows, "condition string, gene string, fc double"), probs.iloc[:1])


def test_pca_scores(spark):
    x = np.random.default_rng(4).normal(size=(200, 5)) * [5, 3, 1, 0.1, 0.1]
    scores, axes, share = E.pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, xf array<double>"), 0.9)
    got = np.array([r["x"] for r in scores.orderBy("cell_id").collect()])
    assert got.shape[1] == len(share) == 2 and np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ axes))
    assert np.allclose(axes.T @ axes, np.eye(2)) and share.sum() > 0.9


def test_koopman_of_a_linear_map():
    rng = np.random.default_rng(5)
    a = np.array([[0.9, 0.1], [-0.1, 0.8]])
    x = [rng.normal(size=2)]
    for _ in range(30):
        x.append(a @ x[-1])
    x = np.array(x)
    h = Q.kernel_sigmas(x, np.eye(2), 50.0, vector=False)
    k = Q.gaussian_kernel(x, x, np.eye(2), h)
    psi_x, psi_y = k[:-1, :-1], k[1:, :-1]
    kk, xi, lam, w = Q.koopman_eig(psi_x, psi_y, 1e-8)
    assert np.allclose(kk @ xi, xi @ lam, atol=1e-6) and (np.diff(np.abs(np.diag(lam))) <= 1e-9).all()
    for m in (Q.update_metric_grad(np.eye(2), x[:-1], xi, h), Q.update_metric_jacobian(np.eye(2), x[:-1], xi[:, :3], np.ones((2, 3)), np.diag(lam)[:3], h)):
        assert np.linalg.norm(m, 2) == pytest.approx(1) and np.allclose(m, m.T)


def test_features_of_a_disc():
    y, x = np.mgrid[:41, :41]
    disc = (x - 20) ** 2 + (y - 20) ** 2 <= 18**2
    img = (x * 3 + y * 7) % 11 + 1.0
    z = X.zernike(disc, img)
    turned = X.zernike(disc.T[::-1], img.T[::-1])
    assert len(z) == 49 and np.allclose(z, turned, atol=1e-8)
    h = X.haralick(disc, img)
    assert len(h) == 13 and np.isfinite(h).all()
    b = X.boundary_fft(disc, img)
    assert len(b) == 15 and b.sum() == pytest.approx(1) and b[0] > 0.9
    assert X.contact_fft(disc, img)[0] == pytest.approx(1) and X.contact_fft(disc, img * disc)[0] < 0.05
    assert X.boundary_fft(np.zeros((3, 3), bool), img[:3, :3]).tolist() == [0] * 15


def test_transport_and_hull():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = rng.integers(1, 6)
        c = rng.integers(0, 20, (n, n)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        a = B.assignment(c)
        assert sorted(a) == list(range(n)) and c[np.arange(n), a].sum() == best
    p = rng.normal(size=(12, 3))
    dx, cost = B.transport(p, p[::-1] + [1.0, 0, 0])
    assert np.allclose(dx, [1.0, 0, 0]) and cost == pytest.approx(1)
    cube = np.array(list(itertools.product([0, 2.0], repeat=3)))
    assert B.hull_volume(np.concatenate([cube, rng.uniform(0.1, 1.9, (50, 3))])) == pytest.approx(8)
    assert B.hull_volume(cube * [1, 1, 0]) == 0
    s = rng.normal(size=(300, 3))
    assert B.hull_volume(s / np.linalg.norm(s, axis=1, keepdims=True)) == pytest.approx(4 / 3 * math.pi, rel=0.1)


def test_bounded_lsq():
    a, b = np.array([[1.0, 0], [0, 1]]), np.array([-1.0, 2])
    assert T.bounded_lsq(a, b).tolist() == [0, 2] and T.bounded_lsq(a, b, -5, 1).tolist() == [-1, 1]


def test_angles_of_opposite_moves_are_rounded_as_in_the_sql(spark):
    """The product over both lengths in turn; where it exceeds -1 the pair is in the last bin, even if unit vectors' product does not."""
    rows, want, other = [], 0, 0
    for i, (a, b, k) in enumerate(itertools.product(range(1, 12), range(1, 12), (1, 3))):
        n, m = math.sqrt(a * a + b * b), math.sqrt(k * a * k * a + k * b * k * b)
        want += -(k * a * a + k * b * b) / m / n > -1
        other += -(k * a / m * (a / n) + k * b / m * (b / n)) > -1
        rows += [(2 * i, i, 0.0, 0.0, float(a), float(b)), (2 * i + 1, i, 0.0, 1.0, float(-k * a), float(-k * b))]
    moving = spark.createDataFrame(rows, "cell_id long, frame int, x double, y double, dx double, dy double")
    got = {r["bin"]: r["n"] for r in M.dx_theta(moving, 5.0, 10).collect()}
    assert got == {9: want} and want != other
