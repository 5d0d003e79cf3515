"""Shape and texture features of cells, as functions of a crop: the registry and the grouped map that applies them.

A feature takes (mask, intensity) arrays of one cell's bounding box and returns
a number or a vector. None changes its arguments.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Feature = Callable[[np.ndarray, np.ndarray], np.ndarray | float]


def size(mask, intensity):
    return float(mask.sum())


def mean_intensity(mask, intensity):
    v = intensity[mask & ~np.isnan(intensity)]
    return float(v.mean()) if len(v) else float("nan")


def total_intensity(mask, intensity):
    return float(np.nansum(intensity[mask]))


def _znorm(v: np.ndarray) -> np.ndarray:
    s = np.nanstd(v)
    return (v - np.nanmean(v)) / s if s > 0 else np.zeros_like(v)


def _boxed(mask, intensity) -> np.ndarray:
    """The cell's box, zero outside the cell, standardised as a whole."""
    return _znorm(np.where(mask, np.nan_to_num(intensity), 0.0))


def zernike(mask, intensity, degree: int = 12) -> np.ndarray:
    """Magnitudes of the Zernike moments up to a degree of the standardised box's absolute values, about their centre of mass."""
    img = np.abs(_boxed(mask, intensity))
    radius, total = max(1, int(np.mean(mask.shape) / 2)), img.sum()
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    if total <= 0:
        return np.zeros(sum(n // 2 + 1 for n in range(degree + 1)))
    dx, dy = (xx - (xx * img).sum() / total) / radius, (yy - (yy * img).sum() / total) / radius
    rho, theta = np.hypot(dx, dy), np.arctan2(dy, dx)
    inside = (rho <= 1) & (img > 0)
    rho, theta, w = rho[inside], theta[inside], img[inside] / img[inside].sum() if inside.any() else img[inside]
    out = []
    for n in range(degree + 1):
        for k in range(n % 2, n + 1, 2):
            r = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + k) // 2 - s) * math.factorial((n - k) // 2 - s)) * rho ** (n - 2 * s) for s in range((n - k) // 2 + 1))
            out.append(abs((w * r * np.exp(-1j * k * theta)).sum()) * (n + 1) / math.pi)
    return np.array(out)


def haralick(mask, intensity, levels: int = 21, span: float = 10.0) -> np.ndarray:
    """13 statistics of grey-level co-occurrence in the standardised box, the mean over four directions; the sum average is per level.

    A level is the number of the edges, evenly from -span to span with one below all, at or under the value.
    """
    v = 1 + np.searchsorted(np.linspace(-span, span, levels), _boxed(mask, intensity), side="right")
    depth, rows = int(v.max()) + 1, []
    for a, b in ((0, 1), (1, 1), (1, 0), (1, -1)):
        h, w = v.shape
        p, q = v[: h - a, max(0, -b) : w - max(0, b)], v[a:, max(0, b) : w - max(0, -b)]
        g = np.zeros((depth, depth))
        np.add.at(g, (p, q), 1)
        g += g.T
        if g.sum():
            rows.append(_glcm(g / g.sum()))
    out = np.mean(rows, axis=0) if rows else np.full(13, np.nan)
    out[5] /= levels
    return out


def _glcm(p: np.ndarray) -> np.ndarray:
    n = len(p)
    i, j = np.mgrid[:n, :n]
    px, k, eps = p.sum(1), np.arange(n), 1e-300
    mean, var = (k * px).sum(), (k * k * px).sum() - (k * px).sum() ** 2
    psum = np.bincount((i + j).ravel(), weights=p.ravel(), minlength=2 * n - 1)
    pdif = np.bincount(np.abs(i - j).ravel(), weights=p.ravel(), minlength=n)
    ks = np.arange(2 * n - 1)
    entropy = lambda q: -(q * np.log2(q + eps)).sum()
    hxy, hx, prod = entropy(p), entropy(px), np.outer(px, px)
    hxy1, hxy2 = -(p * np.log2(prod + eps)).sum(), entropy(prod)
    sumavg = (ks * psum).sum()
    return np.array([
        (p * p).sum(), ((i - j) ** 2 * p).sum(), ((i * j * p).sum() - mean**2) / var if var > 0 else 1.0, var, (p / (1 + (i - j) ** 2)).sum(), sumavg,
        (ks**2 * psum).sum() - sumavg**2, entropy(psum), hxy, pdif.var(), entropy(pdif), (hxy - hxy1) / hx if hx > 0 else 0.0, math.sqrt(max(0.0, 1 - math.exp(-2 * (hxy2 - hxy)))),
    ])


def _border(mask: np.ndarray) -> np.ndarray:
    m = np.pad(mask, 1)
    inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return mask & ~inner


def _polar(mask: np.ndarray, values: np.ndarray | None, nth: int) -> np.ndarray:
    """A border quantity on an even grid of angles about the middle of the box; the radius without values."""
    y, x = np.nonzero(_border(mask))
    dy, dx = y - mask.shape[0] / 2, x - mask.shape[1] / 2
    theta, order = np.arctan2(dy, dx), None
    order = np.argsort(theta, kind="stable")
    theta, at = np.unique(theta[order], return_index=True)
    v = (np.hypot(dx, dy) if values is None else values[y, x])[order][at]
    return np.interp(np.linspace(-np.pi, np.pi, nth + 2)[1:-1], np.concatenate([[-np.pi], theta, [np.pi]]), np.concatenate([v[:1], v, v[-1:]]))


def boundary_fft(mask, intensity, ncomp: int = 15, nth: int = 256) -> np.ndarray:
    """Leading Fourier magnitudes of radius against angle, scaled to add to one; zeros for an empty mask."""
    if not mask.any():
        return np.zeros(ncomp)
    f = np.abs(np.fft.rfft(_polar(mask, None, nth)))[:ncomp]
    return f / f.sum()


def nucleus_boundary_fft(mask, intensity, ncomp: int = 15, nth: int = 256) -> np.ndarray:
    own = mask & (intensity > 0)
    return boundary_fft(own, intensity, ncomp, nth) if own.any() else np.full(ncomp, np.nan)


def contact_fft(mask, intensity, ncomp: int = 15, nth: int = 256) -> np.ndarray:
    """Leading Fourier magnitudes of whether the border has foreground (intensity > 0) beyond it; the first is the share in contact."""
    if not mask.any():
        return np.zeros(ncomp)
    free = np.pad(intensity <= 0, 1, constant_values=True)
    near = free[:-2, 1:-1] | free[2:, 1:-1] | free[1:-1, :-2] | free[1:-1, 2:]
    return np.abs(np.fft.rfft(_polar(mask, (~near).astype(float), nth)))[:ncomp] / nth


FEATURES: dict[str, Feature] = {"size": size, "mean_intensity": mean_intensity, "total_intensity": total_intensity, "zernike": zernike, "haralick": haralick, "boundary_fft": boundary_fft, "nucleus_boundary_fft": nucleus_boundary_fft, "contact_fft": contact_fft}


#: Features that are taken of a whole stack; others are the mean over its slices, slices without a number left out.
WHOLE = frozenset(("size", "mean_intensity", "total_intensity"))


def _of_stack(f: Feature, whole: bool, mask: np.ndarray, img: np.ndarray) -> np.ndarray:
    if mask.ndim == 2 or whole:
        return np.atleast_1d(f(mask.copy(), img.copy()))
    each = np.array([np.atleast_1d(f(m.copy(), v.copy())) for m, v in zip(mask, img) if m.any()])
    known = ~np.isnan(each)
    return np.where(known.any(0), np.where(known, each, 0).sum(0) / np.maximum(known.sum(0), 1), np.nan)


def cell_features(px: DataFrame, channel: str, names: list[str], preprocess: list[Callable] | None = None, registry: dict[str, Feature] | None = None) -> DataFrame:
    """(frame, label, xf): the named features of each cell one after another. One group is one cell's pixels, a stack where the table has a z."""
    functions = [((registry or FEATURES)[n], registry is None and n in WHOLE) for n in names]
    steps, axes = list(preprocess or []), ["z", "y", "x"] if "z" in px.columns else ["y", "x"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[a].to_numpy() - pdf[a].min() for a in axes)
        shape = tuple(int(a.max()) + 1 for a in at)
        mask, img = np.zeros(shape, bool), np.full(shape, np.nan)
        mask[at] = True
        img[at] = pdf[channel].to_numpy(float)
        for s in steps:
            img = s(img)
        out = np.concatenate([_of_stack(f, whole, mask, img) for f, whole in functions])
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "label": [pdf["label"].iloc[0]], "xf": [out.astype(float)]})

    return px.where("label > 0").select("frame", "label", *axes, channel).groupBy("frame", "label").applyInPandas(one, "frame int, label int, xf array<double>")


def apply_slices(px: DataFrame, function: Callable[[np.ndarray], np.ndarray], channel: str, key: list[str]) -> DataFrame:
    """A function of a picture on each slice: the given keys, x, y, value."""
    kinds = {f.name: f.dataType.simpleString() for f in px.schema.fields}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        img = np.full((y.max() + 1, x.max() + 1), np.nan)
        img[y, x] = pdf[channel].to_numpy(float)
        return pdf[[*key, "x", "y"]].assign(value=function(img)[y, x].astype(float))

    return px.groupBy(*key).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in [*key, "x", "y"]) + ", value double")


def fft_magnitude(img: np.ndarray) -> np.ndarray:
    """Magnitudes of the two-dimensional transform with the zero frequency in the middle."""
    return np.abs(np.fft.fftshift(np.fft.fft2(np.nan_to_num(img))))


def align(mask: np.ndarray, img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both turned so that the mask's long axis lies along x, by nearest pixels about its centre."""
    y, x = np.nonzero(mask)
    c = np.array([y.mean(), x.mean()])
    w, v = np.linalg.eigh(np.cov(np.stack([y - c[0], x - c[1]]), bias=True))
    angle = np.arctan2(v[0, 1], v[1, 1])
    yy, xx = np.mgrid[: mask.shape[0], : mask.shape[1]]
    dy, dx = yy - c[0], xx - c[1]
    sy = np.rint(c[0] + np.cos(angle) * dy + np.sin(angle) * dx).astype(int)
    sx = np.rint(c[1] - np.sin(angle) * dy + np.cos(angle) * dx).astype(int)
    ok = (sy >= 0) & (sy < mask.shape[0]) & (sx >= 0) & (sx < mask.shape[1])
    out_m, out_i = np.zeros_like(mask), np.zeros_like(img)
    out_m[ok], out_i[ok] = mask[sy[ok], sx[ok]], img[sy[ok], sx[ok]]
    return out_m, out_i


def masked_distance(a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray) -> float:
    """Euclidean distance over the common mask by its area; NaN without one."""
    both = ma & mb
    return float(np.sqrt(((a - b)[both] ** 2).sum()) / both.sum()) if both.any() else float("nan")


def best_turn_distance(a: np.ndarray, b: np.ndarray, ma: np.ndarray, mb: np.ndarray, turns: int = 4) -> float:
    """The least masked distance over quarter turns of square pictures."""
    return float(np.nanmin([masked_distance(a, np.rot90(b, k), ma, np.rot90(mb, k)) for k in range(turns)]))
