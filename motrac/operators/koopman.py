"""Kernel Koopman models: bandwidths, kernels, spectra, modes, inference, metric updates.

Kernels between rows are Spark expressions for a stated query set; the linear
algebra takes numpy arrays of the training rows. Beyond DENSE rows it holds two
real matrices, or one complex one, of the square of the rows at most: kernels are
made by blocks of rows, and equations are solved where they stand. Blocks are
made on as many threads as the task has cores.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.operators.embed import distance_rows

#: Rows up to which all vectors of a model are taken from one decomposition.
DENSE = 1000

#: Rows of a kernel that are made at once, and rows and columns of a panel.
ROWS, PANEL = 256, 128

#: Squarings before leading vectors are looked for, columns of their basis after which they are looked at, and most of these.
SQUARED, LOOK, BASIS = 8, 100, 800


def gaussian_kernel_rows(y: DataFrame, x: DataFrame, h: float) -> DataFrame:
    """(i, j, k) for all rows of y and x under the identity metric: exp(-d^2 / 2h)."""
    return distance_rows(y, x).select("i", "j", F.exp(-F.col("d") * F.col("d") / (2 * h)).alias("k"))


def _each(function, parts) -> None:
    """function of each part, as many at a time as the task has cores."""
    task = TaskContext.get()
    with ThreadPoolExecutor(task.cpus() if task else 1) as pool:
        list(pool.map(function, parts))


def _as_real(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x.real, x.imag], axis=1) if np.iscomplexobj(x) else x


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = _as_real(x), _as_real(y)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def kernel_sigmas(x: np.ndarray, m: np.ndarray, s: float = 0.05, vector: bool = True):
    """s times each column's variance of the metric's distances; or s times the deviation of all entries of xM."""
    xm = x @ m
    return s * np.concatenate([distances(xm[at : at + ROWS], xm).std(1) ** 2 for at in range(0, len(xm), ROWS)]) if vector else s * np.sqrt(xm.var())


def gaussian_kernel(x: np.ndarray, y: np.ndarray, m: np.ndarray, h) -> np.ndarray:
    """Rows of y by rows of x."""
    return np.exp(-(distances(y @ m, x @ m) ** 2) / (2 * h))


def kernel_rows(x: np.ndarray, y: np.ndarray, m: np.ndarray, h):
    """The kernel's rows by blocks: (a slice of y's rows, theirs)."""
    for at in range(0, len(y), ROWS):
        yield slice(at, at + ROWS), gaussian_kernel(x, y[at : at + ROWS], m, h)


def factor(a: np.ndarray) -> np.ndarray:
    """Puts the triangles of a, its rows exchanged for the largest pivots, in its place: the rows' order. No pivot is left at zero."""
    n, order = len(a), np.arange(len(a))
    least = np.finfo(float).eps * max((np.abs(a[at : at + ROWS]).max() for at in range(0, n, ROWS)), default=0) or 1.0
    for k in range(0, n, PANEL):
        e = min(k + PANEL, n)
        own = np.asfortranarray(a[k:, k:e])
        for j in range(e - k):
            own[:j, j] = np.linalg.solve(np.tril(own[:j, :j], -1) + np.eye(j), own[:j, j])
            own[j:, j] -= own[j:, :j] @ own[:j, j]
            p = j + int(np.abs(own[j:, j]).argmax())
            if p != j:
                own[[j, p]], a[[k + j, k + p]], order[[k + j, k + p]] = own[[p, j]], a[[k + p, k + j]], order[[k + p, k + j]]
            if abs(own[j, j]) < least:
                own[j, j] = least
            own[j + 1 :, j] /= own[j, j]
        a[k:, k:e] = own
        if e < n:
            a[k:e, e:] = np.linalg.solve(_lower(a, k, e), a[k:e, e:])

            def rest(at, k=k, e=e):
                a[at : at + ROWS, e:] -= a[at : at + ROWS, k:e] @ a[k:e, e:]

            _each(rest, range(e, n, ROWS))
    return order


def _lower(a: np.ndarray, k: int, e: int) -> np.ndarray:
    return np.tril(a[k:e, k:e], -1) + np.eye(e - k)


def solve_factored(a: np.ndarray, order: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The columns of b become the solutions, some at a time; a and order are from factor."""
    starts = range(0, len(a), PANEL)

    def some(at):
        y = b[order, at : at + 2 * ROWS]
        for k in starts:
            y[k : k + PANEL] = np.linalg.solve(_lower(a, k, min(k + PANEL, len(a))), y[k : k + PANEL] - a[k : k + PANEL, :k] @ y[:k])
        for k in reversed(starts):
            e = min(k + PANEL, len(a))
            y[k:e] = np.linalg.solve(np.triu(a[k:e, k:e]), y[k:e] - a[k:e, e:] @ y[e:])
        b[:, at : at + 2 * ROWS] = y

    _each(some, range(0, b.shape[1], 2 * ROWS))
    return b


def solve_adjoint(a: np.ndarray, order: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solutions for y with the conjugate transpose of what was factored."""
    y, starts, out = y.copy(), range(0, len(a), PANEL), np.empty_like(y)
    for k in starts:
        e = min(k + PANEL, len(a))
        y[k:e] = np.linalg.solve(np.triu(a[k:e, k:e]).conj().T, y[k:e] - (y[:k].conj().T @ a[:k, k:e]).conj().T)
    for k in reversed(starts):
        e = min(k + PANEL, len(a))
        y[k:e] = np.linalg.solve(_lower(a, k, e).conj().T, y[k:e] - (y[e:].conj().T @ a[e:, k:e]).conj().T)
    out[order] = y
    return out


def koopman_operator(x: np.ndarray, y: np.ndarray, m: np.ndarray, h, bta: float, obs: np.ndarray | None = None):
    """K of (psi_x + bta I) K = psi_y, and the solution for the observables; beyond DENSE rows two matrices at most are held."""
    if len(x) <= DENSE:
        left = gaussian_kernel(x, x, m, h) + bta * np.eye(len(x))
        return tuple(None if b is None else np.linalg.lstsq(left, b, rcond=None)[0] for b in (gaussian_kernel(x, y, m, h), obs))
    left, k = np.empty((len(x), len(x))), np.empty((len(x), len(x)))
    for own, rows in kernel_rows(x, x, m, h):
        left[own] = rows
    left[np.diag_indices(len(x))] += bta
    for own, rows in kernel_rows(x, y, m, h):
        k[own] = rows
    order = factor(left)
    return solve_factored(left, order, k), None if obs is None else solve_factored(left, order, obs.astype(float))


def _squared(k: np.ndarray, times: int) -> np.ndarray:
    """k squared so many times, each time scaled to a largest entry of one; k is written over."""
    new = np.empty_like(k)
    for _ in range(times):

        def some(at, k=k, new=new):
            np.matmul(k[at : at + 4 * ROWS], k, out=new[at : at + 4 * ROWS])

        _each(some, range(0, len(k), 4 * ROWS))
        largest = max(new.max(), -new.min())
        if not 0 < largest < np.inf:
            raise ArithmeticError("no power is left")
        new /= largest
        k, new = new, k
    return k


def _largest(a: np.ndarray, count: int) -> np.ndarray | None:
    """An orthonormal real basis of the vectors of the count eigenvalues of largest modulus, one more and their conjugates, by Arnoldi's method; None if BASIS columns do not hold them."""
    n, most = len(a), min(len(a), BASIS)
    q, h, v = np.empty((most, n)), np.zeros((most, most)), np.random.default_rng(0).normal(size=n)
    size, image = np.linalg.norm(v), np.empty(n)
    for j in range(most):
        q[j] = v / size
        if j:
            h[j, j - 1] = size

        def some(at, j=j):
            image[at : at + 4 * ROWS] = a[at : at + 4 * ROWS] @ q[j]

        _each(some, range(0, n, 4 * ROWS))
        v = image
        for _ in range(2):
            c = q[: j + 1] @ v
            v = v - c @ q[: j + 1]
            h[: j + 1, j] += c
        size = np.linalg.norm(v)
        ended = j + 1 == most or size <= 1e-13 * np.linalg.norm(image)
        if ended and j <= count:
            return None
        if ended or (j + 1) % LOOK == 0:
            w, y = np.linalg.eig(h[: j + 1, : j + 1])
            order = np.argsort(-np.abs(w), kind="stable")
            top = order[: count + 1 + bool(w[order[count]].imag and w[order[count]] != w[order[count - 1]].conj())]
            if (size * np.abs(y[-1, top])).max() <= 1e-11 * np.abs(w[order[0]]):
                parts = [(y[:, i].real, y[:, i].imag) if w[i].imag else (y[:, i].real,) for i in top if w[i].imag >= 0]
                return np.linalg.qr(q[: j + 1].T @ np.stack([c for both in parts for c in both], axis=1))[0]
        if ended:
            return None


def _leading_values(x: np.ndarray, y: np.ndarray, m: np.ndarray, h, count: int, bta: float, k: np.ndarray) -> np.ndarray | None:
    """The count eigenvalues of largest modulus of K from a power of K; None where they do not stand out there. k is written over.

    All moduli lie on nearly a circle, but those of a high power do not: its
    leading vectors, which are K's own, come from products with it. The
    eigenvalues are those of the model within these vectors.
    """
    right = _largest(_squared(k, SQUARED), count)
    if right is None:
        return None
    then, now = np.empty_like(right), np.empty_like(right)
    for (own, rows), (_, ahead) in zip(kernel_rows(x, x, m, h), kernel_rows(x, y, m, h)):
        now[own], then[own] = rows @ right, ahead @ right
    now += bta * right
    lam, own = np.linalg.eig(np.linalg.lstsq(now, then, rcond=None)[0])
    order = np.argsort(-np.abs(lam), kind="stable")[:count]
    lam, own = lam[order], own[:, order]
    good = np.linalg.norm(then @ own - now @ own * lam, axis=0).max() < 1e-7 * np.linalg.norm(now @ own, axis=0).min()
    return lam if good else None


def leading_modes(x: np.ndarray, y: np.ndarray, m: np.ndarray, h, count: int, bta: float = 1e-5):
    """The count leading eigenvalues of the kernel model from x to y, their right vectors, eigenfunctions on x and modes of x.

    As koopman_eig and koopman_modes have them, by whose means they are found up to
    DENSE rows. Beyond, the eigenvalues come from a power of K, or where they do not
    stand out in it from all of them, found without vectors, and the vectors of the
    leading ones from psi_y - lambda (psi_x + bta I), factored anew for each.
    """
    n = len(x)
    if n <= DENSE:
        psi_x = gaussian_kernel(x, x, m, h)
        _, xi, lam, w = koopman_eig(psi_x, gaussian_kernel(x, y, m, h), bta)
        return np.diag(lam)[:count], xi[:, :count], *koopman_modes(psi_x, xi[:, :count], w[:, :count], x, bta)
    k, solved = koopman_operator(x, y, m, h, bta, x)
    lam = _leading_values(x, y, m, h, count, bta, k)
    del k
    if lam is None:
        lam = np.linalg.eigvals(koopman_operator(x, y, m, h, bta)[0])
    lam = lam[np.argsort(-np.abs(lam), kind="stable")[:count]].astype(complex)
    xi, u = np.empty((n, len(lam)), complex), np.empty((n, len(lam)), complex)
    for i, at in enumerate(lam):
        twin = np.flatnonzero((lam[:i] == at.conj()) & (at.imag != 0))
        if len(twin):
            xi[:, i], u[:, i] = xi[:, twin[0]].conj(), u[:, twin[0]].conj()
            continue
        value = at if at.imag else at.real
        a = np.empty((n, n), type(value))
        for (own, rows), (_, then) in zip(kernel_rows(x, x, m, h), kernel_rows(x, y, m, h)):
            a[own] = then - value * rows
        a[np.diag_indices(n)] -= value * bta
        order, start = factor(a), np.random.default_rng(i).normal(size=(n, 1)).astype(a.dtype)
        right, left = start / np.linalg.norm(start), start / np.linalg.norm(start)
        for _ in range(3):
            right, left = solve_factored(a, order, right), solve_adjoint(a, order, left)
            small = 1 / min(np.linalg.norm(right), np.linalg.norm(left))
            right, left = right / np.linalg.norm(right), left / np.linalg.norm(left)
        if not small < 1e-7:
            raise ArithmeticError("the vectors of a leading eigenvalue did not settle")
        top = right[np.abs(right).argmax()]
        xi[:, i], u[:, i] = (right * (np.abs(top) / top))[:, 0], left[:, 0]  # the largest entry is real, as LAPACK leaves it
        del a
    phi, w = np.empty_like(xi), np.empty_like(xi)
    for own, rows in kernel_rows(x, x, m, h):
        phi[own], w[own] = rows @ xi, rows @ u
    w += bta * u
    return lam, xi, phi, solved.T @ w @ np.linalg.inv(xi.conj().T @ w)


def koopman_eig(psi_x: np.ndarray, psi_y: np.ndarray, bta: float = 1e-5):
    """K, right vectors, eigenvalues by falling modulus, left vectors, of (psi_x + bta I) K = psi_y."""
    k = np.linalg.lstsq(psi_x + bta * np.eye(len(psi_x)), psi_y, rcond=None)[0]
    lam, xi = np.linalg.eig(k)
    order = np.argsort(-np.abs(lam))
    lam, xi = lam[order], xi[:, order]
    mu, left = np.linalg.eig(k.conj().T)
    near = np.abs(mu.conj()[None, :] - lam[:, None])
    w = np.empty_like(left)
    for i in range(len(lam)):
        j = int(near[i].argmin())
        w[:, i] = left[:, j]
        near[:, j] = np.inf
    return k, xi, np.diag(lam), w


def koopman_modes(psi_x: np.ndarray, xi: np.ndarray, w: np.ndarray, obs: np.ndarray, bta: float = 1e-5):
    """Eigenfunctions on the training rows, and the modes of the observables."""
    b = np.linalg.lstsq(psi_x + bta * np.eye(len(psi_x)), obs.astype(complex), rcond=None)[0]
    scaled = w / np.conj(np.diag(w.conj().T @ xi))[None, :]
    return psi_x @ xi, b.conj().T @ scaled


def koopman_inference(starts, steps: int, phi: np.ndarray, v: np.ndarray, lam: np.ndarray, modes) -> np.ndarray:
    """Observables from each start over steps: the real part of (phi lambda^s) V*."""
    modes = np.arange(modes) if np.isscalar(modes) else np.asarray(modes)
    lam = np.diag(lam) if lam.ndim == 2 else lam
    powers = lam[modes][None, :] ** np.arange(steps)[:, None]
    return np.real(np.einsum("sm,tm,om->sto", phi[np.asarray(starts)][:, modes], powers, v[:, modes].conj()))


def sqrt_psd(a: np.ndarray) -> np.ndarray:
    """The root of a Hermitian matrix without negative eigenvalues."""
    w, v = np.linalg.eigh((a + a.conj().T) / 2)
    return (v * np.sqrt(np.maximum(w, 0))) @ v.conj().T


def _metric(outer: np.ndarray) -> np.ndarray:
    """The root, scaled so that its largest singular value is one; a matrix without any content stays zero."""
    m = sqrt_psd(outer)
    norm = np.linalg.norm(m, 2)
    return m / norm if norm > 0 else m


def _slopes(x: np.ndarray, kernel, coef: np.ndarray, metric: np.ndarray):
    """For each row n the sums over rows i of k[n, i] coef[i] (x_i - x_n) metric, some rows at a time: (row, axis, component).

    kernel: blocks of the kernel's rows. A row's own share, zero, is left out before the difference is taken.
    """
    both = (x[:, :, None] * coef[:, None, :]).reshape(len(x), -1)
    for own, k in kernel:
        at = np.arange(len(x))[own]
        k[np.arange(len(at)), at] = 0
        yield metric.T @ ((k @ both).reshape(len(at), x.shape[1], -1) - x[own][:, :, None] * (k @ coef)[:, None, :])


def update_metric_grad(m: np.ndarray, x: np.ndarray, phi: np.ndarray, h) -> np.ndarray:
    """The root of the summed outer products of the eigenfunctions' slopes under the metric m."""
    out = 0
    for g in _slopes(x, kernel_rows(x, x, m, h), phi, m):
        out = out + np.einsum("nac,nbc->ab", g.conj(), g, optimize=True)
    return _metric(out)


def update_metric_jacobian(m: np.ndarray, x: np.ndarray, xi: np.ndarray, v: np.ndarray, lam: np.ndarray, h) -> np.ndarray:
    """The same of the model's Jacobian: slopes under m times its conjugate, with coefficients xi lambda V*."""
    lam = np.diag(lam) if lam.ndim == 2 else lam
    out = 0
    for g in _slopes(x.conj(), kernel_rows(x, x, m, h), xi, (m @ m.conj().T).T):
        j = g @ (lam[:, None] * v.conj().T)
        out = out + np.einsum("nac,nbc->ab", j, j.conj(), optimize=True)
    return _metric(out)


def update_metric_jacobian_log(m: np.ndarray, x: np.ndarray, phi: np.ndarray, v: np.ndarray, lam: np.ndarray, h) -> np.ndarray:
    """The older form: slopes of the eigenfunctions under m, weighted by the logarithms of the eigenvalues; real."""
    lam = np.diag(lam) if lam.ndim == 2 else lam
    weight, out = (np.log(lam.astype(complex))[None, :] * v).T, 0
    for g in _slopes(x, kernel_rows(x, x, m, h), phi, m):
        j = g @ weight
        out = out + np.real(np.einsum("nac,nbc->ab", j, j.conj(), optimize=True))
    return np.real(_metric(out))


def update_metric_flux(m: np.ndarray, x: np.ndarray, phi: np.ndarray, v: np.ndarray, lam: np.ndarray, h) -> np.ndarray:
    """The root of the summed outer products of the predicted velocities, eigenfunctions smoothed by the kernel."""
    lam = np.diag(lam) if lam.ndim == 2 else lam
    out = 0
    for _, k in kernel_rows(x, x, m, h):
        f = (k @ phi * np.log(lam.astype(complex))[None, :]) @ v.conj().T
        out = out + f.conj().T @ f
    return _metric(out)
