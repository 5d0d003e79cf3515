"""Kernel models beyond a few rows: equations solved where they stand, leading vectors without the others, no matrix on the driver."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from motrac.operators import koopman
from motrac.plans import catalog


def _vectors(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").sort_by("vec_id")
    return np.array(t.column("embedding").to_pylist(), float)


@pytest.mark.parametrize("kind", [float, complex])
def test_equations_are_solved_in_place(kind):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 300)).astype(kind) + (1j * rng.normal(size=(300, 300)) if kind is complex else 0)
    b, held = rng.normal(size=(300, 5)).astype(kind), a.copy()
    order = koopman.factor(held)
    assert np.allclose(a @ koopman.solve_factored(held, order, b.copy()), b) and np.allclose(a.conj().T @ koopman.solve_adjoint(held, order, b), b)
    none = np.zeros((3, 3))
    koopman.factor(none)
    assert np.diag(none).all()


def test_eigenvalues_are_made_on_an_executor(spark, sf_dir):
    """Before, the driver held the matrices. The moduli are those of the dense model."""
    got = catalog.queries()["koopman_eigenvalues"](spark, sf_dir)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    x = _vectors(sf_dir)
    k = koopman.gaussian_kernel(x, x, np.eye(x.shape[1]), koopman.kernel_sigmas(x, np.eye(x.shape[1]), 0.5))
    want = np.sort(np.abs(np.linalg.eigvals(np.linalg.lstsq(k[:-1, :-1] + 1e-2 * np.eye(len(x) - 1), k[1:, :-1], rcond=None)[0])))[::-1]
    rows = got.orderBy("k").collect()
    assert [r["k"] for r in rows] == list(range(len(x) - 1)) and len(want) == len(rows) and (np.diff([r["modulus"] for r in rows]) <= 0).all()


def test_operator_in_place_equals_dense(monkeypatch):
    """Two matrices in blocks, for a bandwidth a column; the moduli that rounding does not make are those of the dense model."""
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(400, 3)), axis=0)
    m, h = np.eye(3), koopman.kernel_sigmas(x, np.eye(3), 0.5)
    assert np.allclose(h, 0.5 * koopman.distances(x, x).std(0) ** 2)
    want = koopman.koopman_operator(x[:-1], x[1:], m, h[:-1], 1e-2, x[:-1])
    monkeypatch.setattr(koopman, "DENSE", 0)
    got = koopman.koopman_operator(x[:-1], x[1:], m, h[:-1], 1e-2, x[:-1])
    for a, b in zip(got, want):
        assert np.abs(a - b).max() <= 1e-9 * np.abs(b).max()


def test_leading_modes_equal_dense(sf_dir, monkeypatch):
    """Leading eigenvalues, right vectors, eigenfunctions and modes from products and solutions in place."""
    x = _vectors(sf_dir)
    m = np.eye(x.shape[1])
    h = koopman.kernel_sigmas(x, m, 0.5, vector=False)
    want = koopman.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)
    monkeypatch.setattr(koopman, "DENSE", 0)
    lam, xi, phi, v = koopman.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)
    order = [int(np.abs(lam - at).argmin()) for at in want[0]]
    assert sorted(order) == list(range(5)) and np.allclose(lam[order], want[0], atol=1e-10)
    for got, dense in ((xi, want[1]), (phi, want[2])):
        assert np.allclose(np.abs(got[:, order]), np.abs(dense), atol=1e-8)
    for turn in (np.conj, np.asarray):
        assert np.allclose((phi * lam) @ turn(v).T, (want[2] * want[0]) @ turn(want[3]).T, atol=1e-8)


@pytest.mark.parametrize("name", ["koopman_inference", "metric_flux", "metric_grad", "metric_jacobian", "metric_jacobian_log"])
def test_models_are_made_on_an_executor(spark, sf_dir, name):
    """Before, the driver held the matrices."""
    got = catalog.queries()[name](spark, sf_dir)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert got.schema.simpleString() == ("struct<start:int,step:int,x:array<double>>" if name == "koopman_inference" else "struct<axis:int,m:array<double>>")
    rows = got.count()
    assert rows == (4 * (len(_vectors(sf_dir)) - 1) if name == "koopman_inference" else 64)


def test_slopes_are_sums_by_blocks(monkeypatch):
    """Blocks of rows of the kernel give what the whole of it gives, and no block is larger; before, the whole kernel was held."""
    rng = np.random.default_rng(8)
    x, coef, metric = rng.normal(size=(30, 3)), rng.normal(size=(30, 2)) + 1j * rng.normal(size=(30, 2)), rng.normal(size=(3, 3))
    k = koopman.gaussian_kernel(x, x, np.eye(3), 0.7)
    monkeypatch.setattr(koopman, "ROWS", 7)
    got = list(koopman._slopes(x, koopman.kernel_rows(x, x, np.eye(3), 0.7), coef, metric))
    assert [len(g) for g in got] == [7, 7, 7, 7, 2]
    for n, g in enumerate(np.concatenate(got)):
        assert np.allclose(g, ((x - x[n]) @ metric * k[n][:, None]).T @ coef)


def test_leading_modes_need_no_full_decomposition(sf_dir, monkeypatch):
    """Leading modes come from a power of K, on several threads; before, all eigenvalues were found."""
    x = _vectors(sf_dir)
    m = np.eye(x.shape[1])
    h = koopman.kernel_sigmas(x, m, 0.5, vector=False)
    want = koopman.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)
    monkeypatch.setattr(koopman, "DENSE", 0)
    found, every = [], koopman._leading_values
    monkeypatch.setattr(koopman, "_leading_values", lambda *a: found.append(every(*a)) or found[-1])
    monkeypatch.setattr(koopman, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"cpus": lambda self: 3})())}))
    lam, _, phi, v = koopman.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)
    assert found[0] is not None and np.allclose(sorted(lam, key=lambda z: (z.real, z.imag)), sorted(want[0], key=lambda z: (z.real, z.imag)), atol=1e-10)
    assert np.allclose((phi * lam) @ v.conj().T, (want[2] * want[0]) @ want[3].conj().T, atol=1e-6)
    monkeypatch.setattr(koopman, "BASIS", 7)  # too few columns: the full way
    lam, _, phi, v = koopman.leading_modes(x[:-1], x[1:], m, h, 5, 1e-2)
    assert found[1] is None and np.allclose((phi * lam) @ v.conj().T, (want[2] * want[0]) @ want[3].conj().T, atol=1e-6)


def test_model_has_a_whole_executor(spark):
    """One task works, so it takes the other slots of its executor too; where profiles are not to be had there is none."""
    from types import SimpleNamespace

    from pyspark import SparkConf

    from motrac.plans.numeric_queries import _whole_executor

    assert _whole_executor(spark) is None
    at = lambda master, **conf: _whole_executor(SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SparkConf(False).setAll([(k.replace("_", "."), v) for k, v in conf.items()]))))
    assert at("spark://a:7077", spark_executor_cores="4").taskResources["cpus"].amount == 4
    assert at("local-cluster[3,2,100]").taskResources["cpus"].amount == 2 and at("spark://a:7077") is None
