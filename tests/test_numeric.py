"""Numeric operators against plain loops, and their edges."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motrac.operators import boundary, embed, features, koopman, markov, motion, stats
from motrac.streaming import transitions


@pytest.mark.parametrize("n, m", [(1, 1), (1, 4), (23, 24), (60, 61), (40, 20)])
def test_transport_is_the_best(n, m):
    """Masses add up, and prices that no cost falls under add up to the cost: no plan is cheaper."""
    rng = np.random.default_rng(n)
    p, q = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
    cost = ((p[:, None] - q[None]) ** 2).sum(2)
    share, u, v = boundary.transport_plan(cost)
    assert (share >= 0).all() and np.allclose(share.sum(1), 1 / n) and np.allclose(share.sum(0), 1 / m)
    assert (cost - u[:, None] - v[None] > -1e-9).all()
    assert (share * cost).sum() == pytest.approx(u.mean() + v.mean())
    assert boundary.transport(p, q)[1] == pytest.approx((share * cost).sum())


def test_transport_of_equal_clouds_is_the_best_assignment():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(6, 3)), rng.normal(size=(6, 3))
    best = min(sum(((p[i] - q[j]) ** 2).sum() for i, j in enumerate(way)) for way in itertools.permutations(range(6))) / 6
    assert boundary.transport(p, q)[1] == pytest.approx(best)


def _series(n=12):
    """A noisy path round three axes."""
    rng, x = np.random.default_rng(3), [np.array([1.0, 0.5, 0.2])]
    for _ in range(n):
        a, b, c = x[-1]
        x.append(x[-1] + 0.05 * np.array([4 * (b - a), a * (2 - c) - b, a * b - c]) + 0.01 * rng.normal(size=3))
    return np.array(x)


def test_koopman_two_iterations_equal_loops():
    """Kernel, eigenfunctions, modes, inference and metric of two rounds, each by sums over single numbers."""
    every = _series()
    x, y, m, bta, keep = every[:-1], every[1:], np.eye(3, dtype=complex).real, 1e-2, 5
    n = len(x)
    for _ in range(2):
        h = koopman.kernel_sigmas(x, m, 0.5, vector=False)
        xm = [[sum(x[i, a] * m[a, b] for a in range(3)) for b in range(3)] for i in range(n)]
        flat = np.array(xm).ravel()
        assert h == pytest.approx(0.5 * math.sqrt(np.mean(np.abs(flat - flat.mean()) ** 2)))
        psi_x, psi_y = koopman.gaussian_kernel(x, x, m, h), koopman.gaussian_kernel(x, y, m, h)
        for i, j in itertools.product(range(n), repeat=2):
            d = sum(abs(sum((y[i, a] - x[j, a]) * m[a, b] for a in range(3))) ** 2 for b in range(3))
            assert psi_y[i, j] == pytest.approx(math.exp(-d / (2 * h)), abs=1e-9)
        k, xi, lam, w = koopman.koopman_eig(psi_x, psi_y, bta)
        assert np.allclose((psi_x + bta * np.eye(n)) @ k, psi_y) and np.allclose(k @ xi, xi @ lam) and np.allclose(w.conj().T @ k, lam @ w.conj().T, atol=1e-6)
        assert (np.diff(np.abs(np.diag(lam))) <= 1e-9).all()
        xi, w, lam = xi[:, :keep], w[:, :keep], np.diag(lam)[:keep]
        phi, v = koopman.koopman_modes(psi_x, xi, w, x, bta)
        solved = np.linalg.solve(psi_x + bta * np.eye(n), x)
        for a, c in itertools.product(range(3), range(keep)):
            top = sum(solved[i, a] * w[i, c] for i in range(n))
            assert v[a, c] == pytest.approx(top / np.conj(sum(np.conj(w[i, c]) * xi[i, c] for i in range(n))))
        got = koopman.koopman_inference([n - 1, 0], 3, phi, v, np.diag(lam), keep)
        for s, t, a in itertools.product(range(2), range(3), range(3)):
            assert got[s, t, a] == pytest.approx(sum(phi[[n - 1, 0][s], c] * lam[c] ** t * np.conj(v[a, c]) for c in range(keep)).real)

        def slope(i, c, coef, metric):
            return [sum(psi_x[i, j] * coef[j, c] * sum((x[j, a] - x[i, a]) * metric[a, b] for a in range(3)) for j in range(n)) for b in range(3)]

        def rooted(parts):
            """A matrix whose square is the sum, scaled by its largest singular value."""
            root = np.zeros((3, 3))
            values, vectors = np.linalg.eigh(sum(parts))
            root = sum(math.sqrt(max(z, 0)) * np.outer(vectors[:, q], vectors[:, q].conj()) for q, z in enumerate(values))
            return root / np.linalg.svd(root)[1].max()

        grads = [np.array(slope(i, c, phi, m)) for i in range(n) for c in range(keep)]
        assert np.allclose(koopman.update_metric_grad(m, x, phi, h), rooted([np.outer(g.conj(), g) for g in grads]), atol=1e-8)
        joined = [sum(np.log(complex(lam[c])) * np.outer(slope(i, c, phi, m), v[:, c]) for c in range(keep)) for i in range(n)]
        assert np.allclose(koopman.update_metric_jacobian_log(m, x, phi, v, lam, h), rooted([np.real(j @ j.conj().T) for j in joined]), atol=1e-8)
        fluxes = [sum(np.log(complex(lam[c])) * sum(psi_x[i, j] * phi[j, c] for j in range(n)) * v[:, c].conj() for c in range(keep)) for i in range(n)]
        assert np.allclose(koopman.update_metric_flux(m, x, phi, v, lam, h), rooted([np.outer(f.conj(), f) for f in fluxes]), atol=1e-8)
        coef = np.array([[sum(xi[j, c] * lam[c] * np.conj(v[a, c]) for c in range(keep)) for a in range(3)] for j in range(n)])
        square = m @ m.conj().T
        jacobians = [sum(psi_x[i, j] * np.outer(square @ (x[j] - x[i]), coef[j]) for j in range(n)) for i in range(n)]
        m = koopman.update_metric_jacobian(m, x, xi, v, lam, h)
        assert np.allclose(m, rooted([j @ j.conj().T for j in jacobians]), atol=1e-8) and np.linalg.norm(m, 2) == pytest.approx(1)


def test_kscore_takes_real_parts():
    """Stay 0.6, go on 0.4 around three states: eigenvalues 1 and 0.4 with imaginary parts."""
    m = np.array([[0.6, 0.4, 0.0], [0.0, 0.6, 0.4], [0.4, 0.0, 0.6]])
    assert markov.kscore(m) == pytest.approx(2 / 0.6)
    assert markov.kscore(np.array([[0.9, 0.1], [0.05, 0.95]])) == pytest.approx(1 / 0.15)
    assert math.isnan(markov.kscore(np.eye(2)))


def _cell():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:11, :9]
    mask = (y - 5) ** 2 / 25 + (x - 4) ** 2 / 14 <= 1
    return mask, np.where(mask, rng.random(mask.shape) * 9 + 1, 77.0)


def test_haralick_equals_counting():
    """The standardised box, background as zero, in 23 levels; sum average by level."""
    mask, img = _cell()
    box = np.where(mask, img, 0.0)
    z = (box - box.mean()) / box.std()
    level = [[sum(v >= e for e in np.linspace(-10, 10, 21)) + 1 for v in row] for row in z]
    rows = []
    for a, b in ((0, 1), (1, 1), (1, 0), (1, -1)):
        counts = {}
        for i, j in itertools.product(range(11), range(9)):
            if 0 <= i + a < 11 and 0 <= j + b < 9:
                p, q = level[i][j], level[i + a][j + b]
                for key in ((p, q), (q, p)):
                    counts[key] = counts.get(key, 0) + 1
        total = sum(counts.values())
        share = {k: v / total for k, v in counts.items()}
        sums = {}
        for (p, q), s in share.items():
            sums[p + q] = sums.get(p + q, 0) + s
        rows.append([sum(s * s for s in share.values()), sum(s * (p - q) ** 2 for (p, q), s in share.items()), sum(s / (1 + (p - q) ** 2) for (p, q), s in share.items()), sum(k * s for k, s in sums.items()) / 21, -sum(s * math.log2(s) for s in share.values())])
    got = features.haralick(mask, img)
    assert got[[0, 1, 4, 5, 8]] == pytest.approx(np.mean(rows, axis=0)) and len(got) == 13


def test_zernike_equals_sums():
    mask, img = _cell()
    box = np.where(mask, img, 0.0)
    z = np.abs((box - box.mean()) / box.std())
    cy, cx = (sum(z[i, j] * (i, j)[k] for i in range(11) for j in range(9)) / z.sum() for k in (0, 1))
    points = [((i - cy) / 5, (j - cx) / 5, z[i, j]) for i in range(11) for j in range(9) if (i - cy) ** 2 + (j - cx) ** 2 <= 25]
    mass = sum(w for *_, w in points)
    first = abs(sum(w / mass * complex(x, -y) for y, x, w in points)) * 2 / math.pi
    second = abs(sum(w / mass * (2 * (x * x + y * y) - 1) for y, x, w in points)) * 3 / math.pi
    got = features.zernike(mask, img)
    assert len(got) == 49 and got[:3] == pytest.approx([1 / math.pi, first, second])


def test_bins_are_those_of_their_edges(spark):
    for low, high, n in ((1e-6, 50.0, 11), (0.0, math.pi, 10), (-2.0, 2.0, 10)):
        edges = motion._edges(low, high, n)
        values = [v for e in edges for v in (e, np.nextafter(e, -9e9), np.nextafter(e, 9e9))] + [low - 5, high + 5, *np.linspace(low, high, 400).tolist()]
        got = spark.createDataFrame([(float(v),) for v in values], "d double").select("d", motion._bin(F.col("d"), low, high, n).alias("bin")).collect()
        assert all(r["bin"] == sum(r["d"] >= e for e in edges) for r in got)


def test_distances_by_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(50)] + [(7, [9.0, 9.0, 9.0]), (99, None)]
    points = spark.createDataFrame(rows, "cell_id long, xf array<double>")
    known = [r for r in rows if r[1]]
    d = lambda a, b: math.dist(a[1], b[1])
    got = sorted((r["i"], r["j"], round(r["d"], 9)) for r in embed.distance_rows(points, points, block=8).collect())
    assert got == sorted((a[0], b[0], round(d(a, b), 9)) for a in known for b in known)
    few = points.where("cell_id in (3, 4)")
    near = sorted((r["i"], r["rank"], r["j"]) for r in embed.knn(few, points, 4, block=8).collect())
    assert near == sorted((a[0], k + 1, b[0]) for a in known if a[0] in (3, 4) for k, b in enumerate(sorted((b for b in known if b[0] != a[0]), key=lambda b: (d(a, b), b[0]))[:4]))
    var = {r["i"]: r["var"] for r in embed.distance_variance(few, points, block=8).collect()}
    assert var == pytest.approx({a[0]: np.var([d(a, b) for b in known]) for a in known if a[0] in (3, 4)})
    curve = {r["eps"]: r["log_sum"] for r in embed.sigma_curve(points, [0.5, 2.0], block=8).collect()}
    assert curve == pytest.approx({e: math.log(sum(math.exp(-d(a, b) ** 2 / (2 * e)) for a in known for b in known)) for e in (0.5, 2.0)})
    none = points.limit(0)
    assert embed.distance_rows(none, points).count() == 0 and embed.knn(points, none, 3).count() == 0


def test_pca_of_nothing(spark):
    schema = "cell_id long, xf array<double>"
    for rows in ([], [(1, None)], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        scores, axes, share = embed.pca(spark.createDataFrame(rows, schema))
        assert scores.count() == len(rows) and len(share) == 0 and axes.shape[1] == 0
    scores, axes, share = embed.pca(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0]), (3, None)], schema), 0.9)
    assert sorted(abs(r["x"][0]) for r in scores.collect()) == pytest.approx([math.sqrt(2)] * 2) and share == pytest.approx([1])


def test_batches_without_values_or_spread(spark):
    of = lambda values: spark.createDataFrame([(v,) for v in values], "v double")
    for a, b in (([], [1.0, 2.0]), ([1.0, 2.0], []), ([1.0, 1.0], [1.0, 1.0]), ([None], [1.0, 2.0]), ([2.0, 2.0], [5.0, 5.0])):
        got = stats.batch_normalization(of(a), of(b))
        assert len(got) == 2 and all(math.isnan(v) or math.isfinite(v) for v in got)
    assert all(map(math.isnan, stats.batch_normalization(of([]), of([1.0, 2.0]))))
    rng = np.random.default_rng(2)
    v = rng.normal(size=3000)
    a, b = stats.batch_normalization(of((2 * v + 1).tolist()), of(v.tolist()))
    assert abs(a - 2) < 0.3 and abs(b - 1) < 0.3


def test_decomposition_leaves_unknown_conditions_out(spark):
    probs = pd.DataFrame([[1.0, 0.0], [0.0, 1.0]], index=["a", "b"], columns=["s", "t"])
    rows = [("a", "g", 2.0), ("b", "g", 3.0), ("other", "g", 50.0), ("a", "h", None), ("b", "h", 4.0)]
    got = {(r["gene"], r["state"]): r["fc"] for r in stats.state_decomposition(spark.createDataFrame(rows, "condition string, gene string, fc double"), probs).collect()}
    assert got == pytest.approx({("g", "s"): 2.0, ("g", "t"): 3.0, ("h", "s"): 0.0, ("h", "t"): 4.0})


def test_prefix_sums_over_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(v)) for k, v in enumerate(rng.integers(0, 50, 300))]
    got = stats.prefix_sum(spark.createDataFrame(rows, "k long, v long").repartition(7), "v", ["v", "k"], "s").collect()
    at, want = 0, {}
    for k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        at += v
        want[k] = at
    assert {r["k"]: r["s"] for r in got} == want and {r["s_total"] for r in got} == {at}


class _State:
    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_late_observations_are_counted():
    state = _State()
    arrive = lambda rows: pd.concat(list(transitions._advance((5,), iter([pd.DataFrame(rows, columns=["traj_id", "pos", "state"])]), state)), ignore_index=True)
    assert arrive([(5, 0, 1), (5, 1, 2)])[["i", "j", "late"]].to_numpy().tolist() == [[1, 2, 0]]
    got = arrive([(5, 0, 9), (5, 1, 9), (5, 2, 3)])
    assert got["late"].tolist() == [2, 0] and got["i"].isna().tolist() == [True, False] and got["j"].tolist()[1] == 3


def test_displacement_deviation_modes(spark):
    """A field that grows by (0.3, 0.4) along a plane has squared slope 0.25; the others are variances of near points."""
    rng = np.random.default_rng(6)
    p = [[float(a), float(b), 0.0] for a, b in rng.random((40, 2)) * 10]
    rows = [(0, 1, q, [3 + 0.3 * q[0] + 0.4 * q[1], 0.0, 0.0]) for q in p] + [(0, 1, [99.0, 0.0, 0.0], None), (0, 2, [0.0, 0.0, 0.0], None)]
    points = spark.createDataFrame(rows, "frame int, index long, pt array<double>, dx array<double>")
    got = {m: {tuple(r["pt"]): r["dev"] for r in boundary.displacement_deviation(points, 6, m).collect()} for m in ("gradient", "plain", "eigen")}
    for q in p:
        near = sorted(rows[:40], key=lambda r: math.dist(r[2], q))[:6]
        assert got["gradient"][tuple(q)] == pytest.approx(0.25)
        assert got["plain"][tuple(q)] == pytest.approx(np.var([r[3][0] for r in near])) and got["eigen"][tuple(q)] == pytest.approx(got["plain"][tuple(q)])
    assert all(got[m][99.0, 0.0, 0.0] is None and got[m][0.0, 0.0, 0.0] is None for m in got)
    with pytest.raises(ValueError):
        boundary.displacement_deviation(points, 6, "other")
