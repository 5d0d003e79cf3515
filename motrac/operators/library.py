"""The boundary library: border points of all frames in one table, and each cell's properties from it, wide.

A point is a row (frame, index, state, pt, n, c, dx_prev, dx_next, near); near
maps the state of other cells to the distance of their nearest point. Cells
without a link, and states without a point in reach, leave nulls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.functions.scalar import dot
from motrac.operators import boundary
from motrac.operators.stats import wide


def near_states(points: DataFrame, rmax: float) -> DataFrame:
    """(frame, index, pt, near): the least distance to points of other cells of the frame within rmax, by those cells' state.

    Points go to the tile of eight times rmax that they are in and to those within reach; a tile compares its own with all there.
    """
    side, reach, schema = 8.0 * rmax, rmax * (1 + 1e-9), {f.name: f.dataType.simpleString() for f in points.schema.fields}
    there = points.select("frame", "index", "state", "pt")
    for k in range(3):
        there = there.withColumn(f"_g{k}", F.explode(F.sequence(*[F.floor((F.col("pt")[k] + d) / side).cast("long") for d in (-reach, reach)])))

    def one(key, pdf):
        if not (np.floor(np.stack(pdf["pt"].to_numpy()) / side) == np.array(key[1:], float)).all(1).any():
            return pdf.iloc[:0][["frame", "index", "pt"]].assign(near=pd.Series([], dtype=object))
        pdf = pdf.sort_values("state", kind="stable", ignore_index=True)
        p, index = np.stack(pdf["pt"].to_numpy()), pdf["index"].to_numpy()
        own = np.flatnonzero((np.floor(p / side) == np.array(key[1:], float)).all(1))
        own = own[np.unique(np.column_stack([index, p])[own], axis=0, return_index=True)[1]]
        states, starts = np.unique(pdf["state"].to_numpy(), return_index=True)
        near = []
        for at in range(0, len(own), 128):
            k = own[at : at + 128]
            d = np.sqrt(((p[k][:, None] - p[None]) ** 2).sum(2))
            d[index[k][:, None] == index[None]] = np.inf
            near += [{s: v for s, v in zip(states.tolist(), row) if v <= rmax} for row in np.minimum.reduceat(d, starts, axis=1).tolist()]
        out = pdf.iloc[own][["frame", "index", "pt"]].assign(near=pd.Series(near, own, object))
        return out[[bool(x) for x in near]]

    fields = f"frame {schema['frame']}, index {schema['index']}, pt array<double>, near map<{schema['state']},double>"
    return there.groupBy("frame", "_g0", "_g1", "_g2").applyInPandas(one, fields)


def _followed(points: DataFrame, links: DataFrame, moves: dict[str, bool], knn: int | None) -> DataFrame:
    """Adds to a cell's points, in order of place, n and c, unless knn is none, and the transport to the cells that it is linked with, together, by name; onward or from before."""
    own = links.select("frame", F.col("index").alias("child"), "parent")
    sides = {
        True: own.select((F.col("frame") - 1).alias("frame"), F.col("parent").alias("index"), "frame", F.col("child").alias("other")).toDF("frame", "index", "at", "other"),
        False: own.select("frame", F.col("child").alias("index"), (F.col("frame") - 1).alias("at"), F.col("parent").alias("other")),
    }
    pairs = None
    for name, onward in moves.items():
        side = sides[onward].withColumn("name", F.lit(name))
        pairs = side if pairs is None else pairs.unionByName(side)
    there = pairs.join(points.select(F.col("frame").alias("at"), F.col("index").alias("other"), F.col("pt").alias("q")), ["at", "other"]).select("frame", "index", "name", "q")
    points, there = points.toDF(*points.columns), there.toDF(*there.columns)  # fresh columns, as both are cuts of one table

    def placed(lists):
        p = np.stack(lists.to_numpy())
        return np.lexsort(p.T[::-1]), p

    def one(key, now: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if now.empty:
            return pd.DataFrame({c: [] for c in columns})
        order, p = placed(now["pt"])
        now, p = now.iloc[order].reset_index(drop=True), p[order]
        if knn is not None:
            n, c = boundary.normals(p, knn)
            now = now.assign(n=list(n), c=c)
        for name, onward in moves.items():
            q = other.loc[other["name"] == name, "q"]
            if len(q):
                at, q = placed(q)
                dx = boundary.transport(p, q[at])[0]
                now[name] = list(dx if onward else -dx)
            else:
                now[name] = pd.Series([None] * len(now), dtype=object)
        return now[columns]

    added = (["n array<double>", "c double"] if knn is not None else []) + [f"{name} array<double>" for name in moves]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields] + added
    columns = points.columns + [a.split()[0] for a in added]
    return points.groupBy("frame", "index").cogroup(there.groupBy("frame", "index")).applyInPandas(one, ", ".join(fields))


def boundary_library(points: DataFrame, links: DataFrame | None = None, rmax: float = 10.0, knn: int = 12, only: tuple[str, ...] = ("n", "c", "dx_prev", "dx_next", "near")) -> DataFrame:
    """The library from border points (frame, index, state, pt); links (frame, index, parent) name a cell's parent in the frame before.

    Without links cells of one index in following frames are linked. dx_next is
    where a point goes, dx_prev where it comes from, both by uniform transport.
    only: the columns that are made.
    """
    shaped = points.select("frame", "index", "state", "pt")
    asked = {"n", "c"} & set(only)
    moves = {name: onward for name, onward in (("dx_prev", False), ("dx_next", True)) if name in only}
    if moves:
        if links is None:
            cells = points.select("frame", "index").distinct()
            links = cells.join(cells.select((F.col("frame") + 1).alias("frame"), "index"), ["frame", "index"]).select("frame", "index", F.col("index").alias("parent"))
        shaped = _followed(shaped, links, moves, knn if asked else None)
    elif asked:
        shaped = boundary.surface_normals(shaped, knn)
    if "near" in only:
        shaped = shaped.join(near_states(points, rmax), ["frame", "index", "pt"], "left")
    return shaped.select("frame", "index", "state", "pt", *only)


def sphere(p: np.ndarray) -> tuple[float, np.ndarray]:
    """Of one cloud: radius and out, as in sphere_radii."""
    far, thick = np.sqrt(((p - p.mean(0)) ** 2).sum(1)), p
    for axis in np.flatnonzero(np.ptp(p, axis=0) == 0):
        half = np.zeros(3)
        half[axis] = 0.5
        thick = np.concatenate([thick - half, thick + half])
    volume = boundary.hull_volume(thick)
    radius = float((3 / (4 * np.pi) * volume) ** (1 / 3) if volume > 0 else far.mean())
    return radius, far - radius


def sphere_radii(library: DataFrame) -> DataFrame:
    """(frame, index, radius, pt, out): the radius of the sphere of the hull's volume, a flat axis one thick, and each point's distance from the middle beyond it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        radius, out = sphere(np.stack(pdf["pt"].to_numpy()))
        return pd.DataFrame({"frame": pdf["frame"], "index": pdf["index"], "pt": pdf["pt"], "radius": radius, "out": out})

    return library.select("frame", "index", "pt").groupBy("frame", "index").applyInPandas(one, "frame int, index long, pt array<double>, radius double, out double")


def library_properties(library: DataFrame, nn_states: list[int], resolution: float = 1.0, only: list[str] | None = None) -> DataFrame:
    """A row a cell: magnitudes of the multipoles l0 and l1 of each charge on its border, and its sphere radius.

    Charges: closeness to each given state, 2 (1 / (resolution d)) - 1; the way come
    along the normal; the way that lies ahead against it; curvature; the distance
    from the middle beyond the sphere's radius. A charge that no point has leaves nulls.
    only: the charges that are asked for, and then the radius with shape alone; a
    library without the columns of the others will do.
    """
    charges = [(f"near_{s}", 2 * (F.lit(1 / resolution) / F.nullif(F.col("near")[s], F.lit(0.0)) - 0.5)) for s in nn_states]
    charges += [("dx_prev", dot(F.col("dx_prev"), F.col("n"))), ("dx_next", -dot(F.col("dx_next"), F.col("n"))), ("curvature", F.col("c"))]
    names = [name for name in (*[name for name, _ in charges], "shape") if only is None or name in only]
    charges = [(name, q) for name, q in charges if name in names]
    if "shape" in names:
        return _whole_cells(library, charges, names)
    rows = library.select("frame", "index", "pt", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), q.alias("q")) for name, q in charges])).alias("k")).select("frame", "index", "pt", "k.*")
    moments = boundary.multipoles(rows, "q", ["frame", "index", "name"])
    long = moments.select("frame", "index", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}_"), "name").alias("name"), F.col(m).alias("v")) for m in ("l0", "l1")])).alias("k")).select("frame", "index", "k.*")
    out = wide(long, ["frame", "index"], "name", "v", [f"{m}_{n}" for n in names for m in ("l0", "l1")])
    return library.select("frame", "index").distinct().join(out, ["frame", "index"], "left")


def _whole_cells(library: DataFrame, charges: list, names: list[str]) -> DataFrame:
    """The properties with the shape's: as that needs a cell's points together, all are summed there, and the library is gone through once."""

    def one(key, pdf):
        p = np.stack(pdf["pt"].to_numpy())
        radius, out = sphere(p)
        row = [*key]
        for name in names:
            q = out if name == "shape" else pdf[f"q_{name}"].to_numpy(float)
            known = ~np.isnan(q)
            l0 = l1 = None
            if known.any():
                place, q = p[known], q[known]
                l0, l1 = q.mean(), np.sqrt(((q[:, None] * (place - place.mean(0))).mean(0) ** 2).sum()) / 3
            row += [l0, l1]
        return pd.DataFrame([[*row, radius]], columns=columns)

    columns = ["frame", "index", *[f"{m}_{n}" for n in names for m in ("l0", "l1")], "radius"]
    rows = library.select("frame", "index", "pt", *[q.alias(f"q_{name}") for name, q in charges])
    return rows.groupBy("frame", "index").applyInPandas(one, ", ".join(["frame int", "index long", *[f"`{c}` double" for c in columns[2:]]]))


def contact_multipoles(points: DataFrame, states: list[int]) -> DataFrame:
    """(frame, index, state, n, l0, l1) of the charge that is 1 on points whose nearest other cell is of the state and -1 elsewhere; cells without such a point have no row.

    points: (frame, index, pt, nn_state).
    """
    rows = points.select("frame", "index", "pt", "nn_state", F.explode(F.array(*map(F.lit, states))).alias("state"))
    rows = rows.withColumn("q", F.when(F.coalesce(F.col("nn_state") == F.col("state"), F.lit(False)), 1.0).otherwise(-1.0))
    some = rows.groupBy("frame", "index", "state").agg(F.count("*").alias("n"), F.max("q").alias("top")).where("top > 0").drop("top")
    return some.join(boundary.multipoles(rows, "q", ["frame", "index", "state"]), ["frame", "index", "state"])
