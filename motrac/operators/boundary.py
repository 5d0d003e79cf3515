"""Boundary point clouds: multipoles, pair forces, normals, transport, volumes, ligand fields.

Points are rows (frame, index, pt ARRAY<DOUBLE>...), index the cell they belong to.
Column arithmetic stays in Spark; what needs a whole cloud is a grouped map by cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motrac.functions.scalar import distance, dot


def multipoles(points: DataFrame, charge: str, by: list[str]) -> DataFrame:
    """l0: the mean charge; l1: a third of the length of the mean of charge times place about the points' centre."""
    p = points.where(F.col(charge).isNotNull() & ~F.isnan(charge))
    w = Window.partitionBy(*by)
    c = [F.col("pt")[k] for k in range(3)]
    p = p.select(*by, F.col(charge).alias("q"), *[(x - F.avg(x).over(w)).alias(f"r{k}") for k, x in enumerate(c)])
    m = p.groupBy(*by).agg(F.avg("q").alias("l0"), *[F.avg(F.col("q") * F.col(f"r{k}")).alias(f"m{k}") for k in range(3)])
    return m.select(*by, "l0", (F.sqrt(F.col("m0") ** 2 + F.col("m1") ** 2 + F.col("m2") ** 2) / 3).alias("l1"))


def nearest_other(points: DataFrame, rmax: float) -> DataFrame:
    """Each point with its nearest point of another cell of the frame within rmax: nn_index, nn_pt, d. A grid join."""
    cells = [F.floor(F.col("pt")[k] / rmax).cast("long") for k in range(3)]
    a, b = points, points.select("frame", F.col("index").alias("nn_index"), F.col("pt").alias("nn_pt"), *[c.alias(f"_h{k}") for k, c in enumerate(cells)])
    for k in range(3):
        a = a.withColumn(f"_g{k}", F.explode(F.sequence(cells[k] - 1, cells[k] + 1)))
    on = [F.col(f"_g{k}") == F.col(f"_h{k}") for k in range(3)]
    near = a.join(b.withColumnRenamed("frame", "_f"), [*on, F.col("frame") == F.col("_f"), F.col("index") != F.col("nn_index")]).withColumn("d", distance(F.col("pt"), F.col("nn_pt"))).where(F.col("d") <= rmax)
    best = near.groupBy(*[F.col(c) for c in points.columns]).agg(F.min(F.struct("d", "nn_index", "nn_pt")).alias("k"))
    return best.select(*points.columns, "k.d", "k.nn_index", "k.nn_pt")


def adhesive_displacement(near: DataFrame, force: Column, alpha: float = 1.0, maxd: float | None = None) -> DataFrame:
    """Displacement along the way to the neighbour by a force of d, scaled so that none exceeds maxd."""
    out = near.withColumn("dx", F.transform(F.zip_with("nn_pt", "pt", lambda a, b: a - b), lambda v: alpha * force * v / F.col("d")))
    if maxd is not None:
        top = out.agg(F.max(F.sqrt(dot(F.col("dx"), F.col("dx")))).alias("_top"))
        scale = F.when(F.col("_top") > maxd, maxd / F.col("_top")).otherwise(1.0)
        out = out.crossJoin(F.broadcast(top)).withColumn("dx", F.transform("dx", lambda v: v * scale)).drop("_top")
    return out


def surface_displacement(points: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Surface tension: less alpha times curvature c along the normal n."""
    return points.withColumn("dx", F.transform("n", lambda v: -alpha * F.col("c") * v))


def flux_displacement(points: DataFrame, mean: float, sigma: float, seed: int, alpha: float = 1.0) -> DataFrame:
    """A Gaussian flux along the normal; the draw is a function of the point, so a rerun gives the same."""
    u = [(F.pmod(F.xxhash64(F.lit(seed + k), "frame", "index", "pt"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1) for k in (0, 1)]
    g = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])
    return points.withColumn("_g", alpha * (mean + sigma * g)).withColumn("dx", F.transform("n", lambda v: F.col("_g") * v)).drop("_g")


def _near(p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    d = ((p[:, None] - q[None]) ** 2).sum(2)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def normals(p: np.ndarray, knn: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Of one cloud: each point's normal, away from the cloud's centre, and the least share of local variance."""
    q = p[_near(p, p, min(knn, len(p)))]
    q = q - q.mean(1, keepdims=True)
    w, v = np.linalg.eigh(q.transpose(0, 2, 1) @ q / q.shape[1])
    n, total = v[:, :, 0], w.sum(1)
    inward = (n * (p - p.mean(0))).sum(1) < 0
    return np.where(inward[:, None], -n, n), np.where(total > 0, np.maximum(w[:, 0], 0) / np.where(total > 0, total, 1), 0.0)


def surface_normals(points: DataFrame, knn: int = 12) -> DataFrame:
    """Adds n, away from the cloud's centre, and c, the least share of local variance, from each point's nearest ones."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        normal, curv = normals(np.stack(pdf["pt"].to_numpy()), knn)
        return pdf.assign(n=list(normal), c=curv)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy("frame", "index").applyInPandas(one, f"{fields}, n array<double>, c double")


def assignment(cost: np.ndarray) -> np.ndarray:
    """The cheapest one-to-one columns of the rows, by shortest augmenting paths."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while True:
            used[j0] = True
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            free = ~used[1:]
            better = free & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.where(free, low[1:], np.inf).argmin())
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[match[1:] - 1] = np.arange(n)
    return out


def transport_plan(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cheapest way to send equal masses of the rows to equal masses of the columns: (shares, row prices, column prices).

    Masses are whole numbers that add up alike on both sides. Each row sends along
    the shortest ways that are left, which may take back what others sent; prices
    never exceed costs, and are costs where mass flows, which proves the plan best.
    """
    n, m = cost.shape
    g = int(np.gcd(n, m))
    supply, demand = np.full(n, m // g), np.full(m, n // g)
    flow, u, v = np.zeros((n, m), np.int64), np.zeros(n), cost.min(0)
    for start in range(n):
        while supply[start]:
            far, way = np.full(m, np.inf), np.zeros(m, int)
            row_far, back = np.full(n, np.inf), np.full(n, -1)
            done, front = np.zeros(m, bool), [start]
            row_far[start] = 0.0
            while True:
                for i in front:
                    new = row_far[i] + np.maximum(cost[i] - u[i] - v, 0)
                    better = ~done & (new < far)
                    far[better], way[better] = new[better], i
                j = int(np.where(done, np.inf, far).argmin())
                done[j] = True
                if demand[j]:
                    break
                front = np.flatnonzero((flow[:, j] > 0) & np.isinf(row_far)).tolist()
                row_far[front], back[front] = far[j], j
            reached = np.isfinite(row_far)
            u[reached] += far[j] - row_far[reached]
            v[done] -= far[j] - far[done]
            path, at = [], j
            while True:
                path.append((way[at], at))
                if way[at] == start:
                    break
                at = back[way[at]]
            taken = [flow[i, back[i]] for i, _ in path[:-1]]
            amount = min(supply[start], demand[j], *taken)
            for i, to in path:
                flow[i, to] += amount
            for i, _ in path[:-1]:
                flow[i, back[i]] -= amount
            supply[start] -= amount
            demand[j] -= amount
    return flow / flow.sum(), u, v


def transport(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Uniform transport with squared distances: each p's displacement to the q it sends most to (the first of equal ones), and the cost."""
    cost = ((p[:, None] - q[None]) ** 2).sum(2)
    share = transport_plan(cost)[0]
    return q[share.argmax(1)] - p, float((share * cost).sum())


def transport_displacement(points: DataFrame, before: DataFrame) -> DataFrame:
    """(index, pt, dx, cost): each cell's points against the parent cloud with the same index, joined cell by cell; dx is null without one."""

    def one(key, now: pd.DataFrame, prev: pd.DataFrame) -> pd.DataFrame:
        if now.empty or prev.empty:
            return pd.DataFrame({"index": now["index"], "pt": now["pt"].astype(object), "dx": pd.Series([None] * len(now), now.index, object), "cost": float("nan")})
        dx, cost = transport(np.stack(now["pt"].to_numpy()), np.stack(prev["pt"].to_numpy()))
        return pd.DataFrame({"index": now["index"], "pt": now["pt"], "dx": list(dx), "cost": cost})

    before = before.toDF(*before.columns)  # fresh columns, should both be cuts of one table
    return points.groupBy("index").cogroup(before.groupBy("index")).applyInPandas(one, "index long, pt array<double>, dx array<double>, cost double")


def _tangent_slopes(p: np.ndarray, f: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The squared slope of f along the surface at each point, by least squares over its nearest points in the plane they span best."""
    out = np.zeros(len(p))
    for i, own in enumerate(near):
        x, y = p[own] - p[i], f[own] - f[i]
        plane = np.linalg.eigh(x.T @ x)[1][:, 1:]
        slope = np.linalg.lstsq(x @ plane, y, rcond=1e-9)[0]
        out[i] = slope @ slope
    return out


def displacement_deviation(points: DataFrame, knn: int = 12, mode: str = "gradient") -> DataFrame:
    """Adds dev: how much the displacements dx differ around each point of its cell.

    gradient: the squared slope of |dx| along the surface. plain: the population
    variance of |dx| over the point's nearest ones. eigen: the summed variances of
    dx's components over them. Points without a dx have no dev and are no neighbours.
    """
    if mode not in ("gradient", "plain", "eigen"):
        raise ValueError("mode is gradient, plain or eigen")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        dev, at = np.full(len(pdf), np.nan), np.flatnonzero(pdf["dx"].notna().to_numpy())
        if len(at):
            p, dx = np.stack(pdf["pt"].to_numpy()[at]), np.stack(pdf["dx"].to_numpy()[at])
            size, near = np.sqrt((dx**2).sum(1)), _near(p, p, min(knn, len(p)))
            dev[at] = _tangent_slopes(p, size, near) if mode == "gradient" else size[near].var(1) if mode == "plain" else dx[near].var(1).sum(1)
        return pdf.assign(dev=dev)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy("frame", "index").applyInPandas(one, f"{fields}, dev double")


def hull_volume(p: np.ndarray) -> float:
    """Volume of the convex hull in three dimensions, grown point by point; 0 if the points are flat."""
    p = np.unique(p - p.mean(0), axis=0)
    eps = 1e-9 * max(1.0, np.abs(p).max() if len(p) else 1.0)
    if len(p) < 4:
        return 0.0
    i = [0]
    i.append(int(((p - p[i[0]]) ** 2).sum(1).argmax()))
    line = p[i[1]] - p[i[0]]
    i.append(int((np.cross(p - p[i[0]], line) ** 2).sum(1).argmax()))
    normal = np.cross(line, p[i[2]] - p[i[0]])
    i.append(int(np.abs((p - p[i[0]]) @ normal).argmax()))
    if abs((p[i[3]] - p[i[0]]) @ normal) <= eps * max(1e-300, np.linalg.norm(normal)):
        return 0.0
    inside = p[i].mean(0)

    def face(a, b, c):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        return (a, b, c) if n @ (p[a] - inside) > 0 else (a, c, b)

    faces = np.array([face(*[i[k] for k in t]) for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))])
    out = np.cross(p[faces[:, 1]] - p[faces[:, 0]], p[faces[:, 2]] - p[faces[:, 0]])
    for k in range(len(p)):
        seen = (out * (p[k] - p[faces[:, 0]])).sum(1) > eps
        if not seen.any():
            continue
        edges = {(f[a], f[(a + 1) % 3]) for f in faces[seen].tolist() for a in range(3)}
        new = np.array([(a, b, k) for a, b in edges if (b, a) not in edges])
        faces = np.concatenate([faces[~seen], new])
        out = np.concatenate([out[~seen], np.cross(p[new[:, 1]] - p[new[:, 0]], p[k] - p[new[:, 0]])])
    a, b, c = p[faces].transpose(1, 0, 2)
    return float((a * np.cross(b, c)).sum() / 6)


def constrain_volume(points: DataFrame, target: float, tolerance: float = 0.05, most: int = 100) -> DataFrame:
    """Each cell's points scaled about their centre until the hull's volume is within tolerance of the target."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(pdf["pt"].to_numpy())
        c = p.mean(0)
        for _ in range(most):
            v = hull_volume(p)
            if v <= 0 or abs(v - target) <= tolerance * target:
                break
            p = c + (p - c) * (target / v) ** (1 / 3)
        return pdf.assign(pt=list(p), volume=v)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy("frame", "index").applyInPandas(one, f"{fields}, volume double")


def ligand_density(px: DataFrame, rate: float = 1.0, decay: float = 0.05, sweeps: int = 200) -> DataFrame:
    """Steady diffusion from cells' pixels on each frame's grid, absorbed at its edge: (frame, x, y, density). Jacobi sweeps by frame."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        source = np.zeros((y.max() + 3, x.max() + 3))
        source[y + 1, x + 1] = rate * (pdf["label"].to_numpy() > 0)
        u = np.zeros_like(source)
        for _ in range(sweeps):
            around = u[:-2, 1:-1] + u[2:, 1:-1] + u[1:-1, :-2] + u[1:-1, 2:]
            u[1:-1, 1:-1] = (around + source[1:-1, 1:-1]) / (4 + decay)
        return pdf[["frame", "x", "y"]].assign(density=u[y + 1, x + 1])

    return px.groupBy("frame").applyInPandas(one, "frame int, x int, y int, density double")


def border_table(px: DataFrame, states: DataFrame | None = None, knn: int = 12, rmax: float = 10.0) -> DataFrame:
    """One row a border point: frame, index, state, pt, n, c, d, nn_index, nn_state, nn_pt. States are (frame, label, state), 1 if none are given."""
    from motrac.operators.cells import borders

    pts = borders(px).select("frame", F.col("label").cast("long").alias("index"), F.array(F.col("x").cast("double"), F.col("y").cast("double"), F.lit(0.0)).alias("pt"))
    pts = surface_normals(pts, knn)
    near = nearest_other(pts.select("frame", "index", "pt"), rmax)
    out = pts.join(near, ["frame", "index", "pt"], "left")
    if states is None:
        return out.select("frame", "index", F.lit(1).alias("state"), "pt", "n", "c", "d", "nn_index", F.when(F.col("nn_index").isNotNull(), 1).alias("nn_state"), "nn_pt")
    s = states.select("frame", F.col("label").cast("long").alias("index"), "state")
    t = s.select("frame", F.col("index").alias("nn_index"), F.col("state").alias("nn_state"))
    return out.join(s, ["frame", "index"], "left").join(t, ["frame", "nn_index"], "left").select("frame", "index", "state", "pt", "n", "c", "d", "nn_index", "nn_state", "nn_pt")


def labels_from_border(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """Pixels inside each cell's convex outline (frame, x, y, label); where outlines meet the larger number stays."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(np.stack(pdf["pt"].to_numpy())[:, :2], axis=0)

        def half(q):
            out = []
            for a in q:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (a[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (a[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(a)
            return out[:-1]

        ring = np.array(half(p) + half(p[::-1])) if len(p) > 2 else p
        x, y = np.meshgrid(np.arange(max(0, int(p[:, 0].min())), min(nx, int(p[:, 0].max()) + 1)), np.arange(max(0, int(p[:, 1].min())), min(ny, int(p[:, 1].max()) + 1)))
        inside = np.ones(x.shape, bool)
        for a, b in zip(ring, np.roll(ring, -1, axis=0)):
            inside &= (b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9
        return pd.DataFrame({"frame": pdf["frame"].iloc[0], "x": x[inside], "y": y[inside], "label": pdf["index"].iloc[0]})

    drawn = points.select("frame", "index", "pt").groupBy("frame", "index").applyInPandas(fill, "frame int, x int, y int, label long")
    return drawn.groupBy("frame", "x", "y").agg(F.max("label").alias("label"))
