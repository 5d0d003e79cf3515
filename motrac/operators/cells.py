"""Cells from labelled pixels: index, boxes, centres, intensities, masks, borders, contacts.

Pixels are rows (frame, x, y, label, channels...); label 0 is background, and so
is a null label. Index, boxes, centres, borders and contacts work in three
dimensions where the table has a z. Empty tables give empty results; of repeated
pixels each counts.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motrac.functions.scalar import correlation
from motrac.sources.scratch import materialize

#: A pixel's number is x times WIDTH plus y; parts are found in tiles of TILE by TILE pixels.
WIDTH, TILE = 1 << 20, 256

#: Neighbours of a pixel: itself not included, corners included.
AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def _axes(px: DataFrame) -> list[str]:
    return ["x", "y", "z"] if "z" in px.columns else ["x", "y"]


def _sides(axes: list[str]) -> list[tuple[int, ...]]:
    """Steps to the neighbours at a side: four in a picture, six in a stack."""
    return [tuple(s * (k == a) for k in range(len(axes))) for a in range(len(axes)) for s in (1, -1)]


def frame_counts(px: DataFrame) -> DataFrame:
    """Cells by frame, for the frames from 0 up to the first that is missing."""
    n = px.groupBy("frame").agg(F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("n_cells"))
    return n.withColumn("_k", F.row_number().over(Window.orderBy("frame")) - 1).where("_k = frame").drop("_k")


def cell_index(px: DataFrame) -> DataFrame:
    """cell_id (frames, then labels, ascending), ind within its frame, box [min, max) along each axis."""
    box = [c for a in _axes(px) for c in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    own = px.where("label > 0").groupBy("frame", "label").agg(*box, F.count("*").alias("n_pixels"))
    own = own.withColumn("ind", F.row_number().over(Window.partitionBy("frame").orderBy("label")) - 1)
    # Numbers run on over frames: a frame's first is the number of cells before it, one row a frame.
    sizes = own.groupBy("frame").agg(F.count("*").alias("n"))
    first = sizes.select("frame", F.coalesce(F.sum("n").over(Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return own.join(first, "frame").select((F.col("first") + F.col("ind")).alias("cell_id"), "frame", "ind", "label", *[f"{a}{k}" for a in _axes(px) for k in (0, 1)], "n_pixels")


def cell_centers(px: DataFrame, zscale: float = 1.0) -> DataFrame:
    """Each cell's mean place; z in units of the other axes by zscale."""
    return px.where("label > 0").groupBy("frame", "label").agg(*[(F.avg(a) * (zscale if a == "z" else 1.0)).alias(a) for a in _axes(px)])


def positions(px: DataFrame, shifts: DataFrame) -> DataFrame:
    """Centres less their frame's registration shift."""
    s = shifts.select("frame", "tx", "ty")
    return cell_centers(px).join(s, "frame", "left").select("frame", "label", (F.col("x") - F.coalesce("tx", F.lit(0.0))).alias("x"), (F.col("y") - F.coalesce("ty", F.lit(0.0))).alias("y"))


def intensities(px: DataFrame, channels: list[str], averaging: bool = False) -> DataFrame:
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    agg = [(F.avg(known(c)) if averaging else F.coalesce(F.sum(known(c)), F.lit(0.0))).alias(c) for c in channels]
    return px.where("label > 0").groupBy("frame", "label").agg(F.count("*").alias("size"), *agg)


def compartment_ratio(px: DataFrame, channel: str, inner: Column, use_sum: bool = False, inverse: bool = False, background: float | None = None) -> DataFrame:
    """Mean (or sum) of a channel inside against outside of `inner`, by cell; null where a part has no pixel.

    background: a percentile in 0..100 of each frame's background that is taken off first.
    """
    v = F.col(channel)
    if background is not None:
        b = px.where("label = 0").groupBy("frame").agg(F.expr(f"percentile({channel}, {background / 100})").alias("_b"))
        px, v = px.join(b, "frame", "left"), F.col(channel) - F.coalesce("_b", F.lit(0.0))
    f = F.sum if use_sum else F.avg
    r = px.where("label > 0").groupBy("frame", "label").agg(f(F.when(inner, v)).alias("inside"), f(F.when(~inner, v)).alias("outside"))
    ratio = F.col("outside") / F.when(F.col("inside") != 0, F.col("inside")) if inverse else F.col("inside") / F.when(F.col("outside") != 0, F.col("outside"))
    return r.withColumn("ratio", ratio)


def channel_crosscorr(px: DataFrame, a: str, b: str) -> DataFrame:
    return px.where("label > 0").groupBy("frame", "label").agg(correlation(F.col(a), F.col(b)).alias("corr"))


def histogram_stretch(px: DataFrame, channel: str, lp: float = 1, hp: float = 99) -> DataFrame:
    """(v - low) / (high - low) by each frame's percentiles, without clipping; null where they are equal."""
    q = px.groupBy("frame").agg(F.expr(f"percentile({channel}, array({lp / 100}, {hp / 100}))").alias("q"))
    return px.join(q, "frame").withColumn("stretched", F.try_divide(F.col(channel) - F.col("q")[0], F.col("q")[1] - F.col("q")[0])).drop("q")


def feature_map(px: DataFrame, features: DataFrame, name: str) -> DataFrame:
    """Each pixel's cell's feature; null on background."""
    return px.join(features.select("frame", "label", F.col(name).alias("feature")), ["frame", "label"], "left").select("frame", "x", "y", "label", "feature")


def voronoi(px: DataFrame, centers: DataFrame) -> DataFrame:
    """Each pixel's nearest centre of its frame; ties to the smaller label. A frame's centres are few and gathered in a row."""
    c = centers.groupBy("frame").agg(F.collect_list(F.struct("label", "x", "y")).alias("cs"))
    d = F.transform("cs", lambda c: F.struct(((F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"])).alias("d"), c["label"].alias("label")))
    return px.drop("label").join(c, "frame").select("frame", "x", "y", F.array_min(d)["label"].alias("label"))


def clean_labels(px: DataFrame, minsize: int | None = None, maxsize: int | None = None, border: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Labels whose size is strictly between the limits and that no border (x0, x1, y0, y1, inclusive) touches, numbered from 1 in order."""
    touches = F.lit(False) if border is None else (F.col("x") <= border[0]) | (F.col("x") >= border[1]) | (F.col("y") <= border[2]) | (F.col("y") >= border[3])
    own = px.where("label > 0").groupBy("frame", "label").agg(F.count("*").alias("n"), F.max(touches.cast("int")).alias("t")).where("t = 0")
    if minsize is not None:
        own = own.where(F.col("n") > minsize)
    if maxsize is not None:
        own = own.where(F.col("n") < maxsize)
    own = own.withColumn("new_label", F.row_number().over(Window.partitionBy("frame").orderBy("label"))).drop("t")
    return px.join(own, ["frame", "label"]).select("frame", "x", "y", "label", "new_label")


def _neighbours(px: DataFrame, offsets: list[tuple[int, ...]], name: str = "other") -> DataFrame:
    """Each labelled pixel with the label at each offset; null outside the image. An equi join over shifted copies."""
    axes = _axes(px)
    shifts = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(axes, o)]) for o in offsets]))
    seen = px.select("frame", *[F.col(a).alias(f"_{a}") for a in axes], F.coalesce("label", F.lit(0)).alias(name))
    moved = px.where("label > 0").select("frame", *axes, "label", shifts.alias("s"))
    moved = moved.select("*", *[(F.col(a) + F.col(f"s.{a}")).alias(f"_{a}") for a in axes])
    return moved.join(seen, ["frame", *[f"_{a}" for a in axes]], "left").select("frame", *axes, "label", name)


def borders(px: DataFrame) -> DataFrame:
    """Pixels of cells with a side neighbour that is another label or outside the image."""
    axes = _axes(px)
    n = _neighbours(px, _sides(axes))
    return n.where((F.col("other") != F.col("label")) | F.col("other").isNull()).select("frame", *axes, "label").distinct()


def contacts(px: DataFrame, radius: int = 1) -> DataFrame:
    """Border pixels with another cell within radius: that cell's label, the smallest if several."""
    axes = _axes(px)
    ball = [o for o in product(range(-radius, radius + 1), repeat=len(axes)) if 0 < sum(v * v for v in o) <= radius * radius]
    n = _neighbours(px, ball).where((F.col("other") > 0) & (F.col("other") != F.col("label")))
    near = n.groupBy("frame", *axes, "label").agg(F.min("other").alias("contact"))
    return near.join(borders(px), ["frame", *axes, "label"], "left_semi")


def contact_edges(px: DataFrame, radius: int = 1) -> DataFrame:
    """Touching cells with their number of contact pixels."""
    return contacts(px, radius).groupBy("frame", "label", "contact").agg(F.count("*").alias("n"))


def neighbour_feature(px: DataFrame, features: DataFrame, name: str, radius: int = 1) -> DataFrame:
    """For each touching pair the difference of a feature, painted on the first one's contact pixels."""
    f = features.select("frame", "label", F.col(name).alias("_f"))
    g = f.select("frame", F.col("label").alias("contact"), F.col("_f").alias("_g"))
    return contacts(px, radius).join(f, ["frame", "label"]).join(g, ["frame", "contact"]).select("frame", "x", "y", "label", "contact", (F.col("_g") - F.col("_f")).alias("value"))


def cc_cs_border(px: DataFrame) -> DataFrame:
    """Border pixels that touch background at a side (cell-stroma) or do not (cell-cell)."""
    axes = _axes(px)
    n = _neighbours(px, _sides(axes))
    free = n.groupBy("frame", *axes, "label").agg(F.max((F.col("other") == 0).cast("int")).alias("free"))
    return borders(px).join(free, ["frame", *axes, "label"]).select("frame", *axes, "label", F.when(F.col("free") == 1, "cs").otherwise("cc").alias("kind"))


def dilate(px: DataFrame, cycles: int = 1) -> DataFrame:
    """Background pixels beside cells take the largest neighbouring label, cycle by cycle."""
    for _ in range(cycles):
        shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in AROUND]))
        near = px.where("label > 0").select("frame", "label", shifts.alias("s"), "x", "y").select("frame", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), F.col("label").alias("_l")).groupBy("frame", "x", "y").agg(F.max("_l").alias("_l"))
        px = px.join(near, ["frame", "x", "y"], "left").withColumn("label", F.when(F.col("label") > 0, F.col("label")).otherwise(F.coalesce("_l", F.lit(0)))).drop("_l")
    return px


def _tile_parts(px: DataFrame, around: list[tuple[int, int]]) -> DataFrame:
    """Adds part: the smallest pixel number that a pixel reaches inside its tile of TILE by TILE pixels and its group."""
    steps = np.array([(a, b) for a, b in around])

    def one(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy().astype(np.int64) for c in "xy")
        number = x * WIDTH + y
        group = table.column("group").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        span = number.max() - number.min() + 2 * WIDTH + 3
        keys, first = np.unique(group * span + number - number.min(), return_index=True)
        label = np.arange(len(keys))
        links = []
        for step in steps[:, 0] * WIDTH + steps[:, 1]:
            found = np.minimum(np.searchsorted(keys, keys + step), len(keys) - 1)
            here = np.flatnonzero(keys[found] == keys + step)
            links.append((here, found[here]))
        u, v = (np.concatenate([k[i] for k in links]) for i in (0, 1))
        while True:
            least = label.copy()
            np.minimum.at(least, u, label[v])
            least = least[least]
            if (least == label).all():
                break
            label = least
        return table.take(first).append_column("part", pa.array(number[first][label]))

    tiled = px.where("frame is not null and x is not null and y is not null").select("frame", "x", "y", "group", *[F.floor(F.col(c) / TILE).alias(f"_{c}") for c in "xy"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiled.schema.fields[:4])
    return tiled.groupBy("frame", "_x", "_y").applyInArrow(lambda t: one(t.select(["frame", "x", "y", "group"])), f"{fields}, part long")


def components(px: DataFrame, group: Column, around: list[tuple[int, int]] = AROUND) -> DataFrame:
    """Connected parts, corners included unless around says otherwise, of pixels with the same non-null group: (frame, x, y, group, part, the smallest pixel number in it).

    Each tile of a picture is a group of its own, whose parts are found in one
    task. Only parts that meet across the edges of tiles go on: they are linked,
    and least numbers spread over the links and jump to their number's number,
    each round written. A stored table of pixels is far smaller than its rows
    in memory, so that its joins say that they sort.
    """
    p = materialize(_tile_parts(px.withColumn("group", group).where("group is not null"), around), "parts")
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    inside = lambda c: F.pmod(F.col(c), F.lit(TILE))
    edge = p.where(" or ".join(f"pmod({c}, {TILE}) in (0, {TILE - 1})" for c in "xy"))
    sent = edge.select("frame", "group", "x", "y", F.col("part").alias("_a"), shifts.alias("s"))
    out = F.col("s.a") + inside("x"), F.col("s.b") + inside("y")
    sent = sent.where(~out[0].between(0, TILE - 1) | ~out[1].between(0, TILE - 1))
    sent = sent.select("frame", "group", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "_a")
    met = sent.join(edge.select("frame", "group", "x", "y", F.col("part").alias("_b")).hint("merge"), ["frame", "group", "x", "y"])
    links = materialize(met.select("frame", "group", "_a", "_b").distinct(), "links")
    if not links.head(1):
        return p
    links = links.unionByName(links.select("frame", "group", F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    label = materialize(links.select("frame", "group", "_a").distinct().withColumn("part", F.col("_a")), "labels")
    before = None
    while True:
        far = links.join(label.select("frame", "group", F.col("_a").alias("_b"), "part").hint("merge"), ["frame", "group", "_b"])
        least = far.select("frame", "group", "_a", "part").unionByName(label).groupBy("frame", "group", "_a").agg(F.min("part").alias("part"))
        jump = least.select("frame", "group", F.col("_a").alias("part"), F.col("part").alias("_next"))
        label = materialize(least.join(jump.hint("merge"), ["frame", "group", "part"]).select("frame", "group", "_a", F.col("_next").alias("part")), "labels")
        total = label.agg(F.sum("part")).first()[0]
        if total == before:
            break
        before = total
    own = label.select("frame", "group", F.col("_a").alias("part"), F.col("part").alias("_least")).hint("merge")
    return p.join(own, ["frame", "group", "part"], "left").select("frame", "x", "y", "group", F.coalesce("_least", "part").alias("part"))


def largest_parts(px: DataFrame) -> DataFrame:
    """Each label's largest connected part; ties to the part with the smallest pixel."""
    p = components(px, F.when(F.col("label") > 0, F.col("label"))).withColumnRenamed("group", "label")
    size = p.groupBy("frame", "label", "part").agg(F.count("*").alias("n"))
    best = size.groupBy("frame", "label").agg(F.max(F.struct("n", (-F.col("part")).alias("k"))).alias("k")).select("frame", "label", (-F.col("k.k")).alias("part"))
    return p.join(best.hint("merge"), ["frame", "label", "part"], "left_semi").select("frame", "x", "y", "label")


def local_threshold(px: DataFrame, channel: str, block: int = 5, z: float = 1.0) -> DataFrame:
    """Whether a pixel exceeds the mean of the block around it by z of the frame's standard deviations."""
    h = block // 2
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-h, h + 1) for b in range(-h, h + 1)]))
    sent = px.select("frame", "x", "y", F.col(channel).alias("_v"), shifts.alias("s")).select("frame", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "_v")
    mean = sent.groupBy("frame", "x", "y").agg(F.avg("_v").alias("_m"))
    sd = px.groupBy("frame").agg(F.stddev_pop(channel).alias("_s"))
    return px.join(mean, ["frame", "x", "y"]).join(F.broadcast(sd), "frame").withColumn("on", F.col(channel) > F.col("_m") + z * F.col("_s")).drop("_m", "_s")


def pad(px: DataFrame, width: int, height: int, nx: int, ny: int) -> DataFrame:
    """The image centred in nx by ny, cut where it is larger."""
    ox, oy = (nx - width) // 2, (ny - height) // 2
    moved = px.withColumn("x", F.col("x") + ox).withColumn("y", F.col("y") + oy)
    return moved.where(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))


def shift(px: DataFrame, shifts: DataFrame) -> DataFrame:
    """Pixels moved by their frame's registration, to the nearest whole pixel."""
    s = shifts.select("frame", "tx", "ty")
    return px.join(s, "frame", "left").withColumn("x", (F.col("x") - F.round(F.coalesce("tx", F.lit(0.0)))).cast("int")).withColumn("y", (F.col("y") - F.round(F.coalesce("ty", F.lit(0.0)))).cast("int")).drop("tx", "ty")


def mosaic(px: DataFrame, size: int, ncols: int, overlap: int) -> DataFrame:
    """Frames as tiles of one picture, row by row; where tiles overlap the later one shows."""
    step = size - overlap
    placed = px.select((F.col("x") + (F.col("frame") % ncols) * step).alias("x"), (F.col("y") + F.floor(F.col("frame") / ncols) * step).alias("y"), "frame", "c1")
    return placed.groupBy("x", "y").agg(F.max_by("c1", "frame").alias("value"))


def crop(px: DataFrame, index: DataFrame, cells: list[int], expansion: int = 0) -> DataFrame:
    """(cell_id, frame, x, y, own...): pixels of each given cell's box and what lies within expansion of it, cut at the image."""
    box = F.broadcast(index.where(F.col("cell_id").isin(cells)).select("cell_id", "frame", F.col("label").alias("_label"), "x0", "x1", "y0", "y1"))
    inside = (F.col("x") >= F.col("x0") - expansion) & (F.col("x") < F.col("x1") + expansion) & (F.col("y") >= F.col("y0") - expansion) & (F.col("y") < F.col("y1") + expansion)
    return px.join(box, "frame").where(inside).select("cell_id", "frame", "x", "y", "label", (F.col("label") == F.col("_label")).alias("own"))


def cyto_minus_nuc(cyto: DataFrame, nuc: DataFrame) -> DataFrame:
    """Cytoplasm labels grown by a pixel, together with nuclei of the same label, less every nucleus pixel."""
    n = nuc.where("label > 0").select("frame", "x", "y", F.col("label").alias("_n"))
    both = cyto.join(n, ["frame", "x", "y"], "left").withColumn("label", F.when(F.col("label") > 0, F.col("label")).otherwise(F.coalesce("_n", F.lit(0)))).drop("_n")
    return dilate(both).where("label > 0").join(n, ["frame", "x", "y"], "left_anti").select("frame", "x", "y", "label")


def intensity_centers(px: DataFrame, channel: str, radius: int = 1) -> DataFrame:
    """Pixels that are the largest within radius; of equal ones the first by place stays."""
    around = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around]))
    key = F.struct(F.col(channel).alias("v"), (-F.col("x")).alias("a"), (-F.col("y")).alias("b"))
    sent = px.select("frame", "x", "y", key.alias("k"), shifts.alias("s")).select("frame", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "k")
    top = sent.groupBy("frame", "x", "y").agg(F.max("k").alias("k"))
    return top.where((-F.col("k.a") == F.col("x")) & (-F.col("k.b") == F.col("y"))).select("frame", "x", "y", F.col("k.v").alias("value"))


def affine(px: DataFrame, matrix: list[float]) -> DataFrame:
    """Pixels at the nearest whole place of a row-major 3 by 3 transform; several on one place leave the largest label."""
    a, b, c, d, e, f = matrix[:6]
    moved = px.select("frame", F.round(a * F.col("x") + b * F.col("y") + c).cast("int").alias("x"), F.round(d * F.col("x") + e * F.col("y") + f).cast("int").alias("y"), "label")
    return moved.groupBy("frame", "x", "y").agg(F.max("label").alias("label"))


def bunches(px: DataFrame, on: Column, least: int) -> DataFrame:
    """Connected parts of over `least` pixels, numbered from 1 in each frame by their smallest pixel."""
    p = components(px, F.when(on, F.lit(1)))
    size = p.groupBy("frame", "part").agg(F.count("*").alias("n")).where(F.col("n") > least)
    size = size.withColumn("bunch", F.row_number().over(Window.partitionBy("frame").orderBy("part")))
    return p.hint("merge").join(size, ["frame", "part"]).select("frame", "x", "y", "bunch")


def bunch_centers(bunched: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """(frame, bunch, x, y): the middle of each bunch less its frame's registration shift."""
    c = bunched.groupBy("frame", "bunch").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    if shifts is None:
        return c
    s = c.join(shifts.select("frame", "tx", "ty"), "frame", "left")
    return s.select("frame", "bunch", (F.col("x") - F.coalesce("tx", F.lit(0.0))).alias("x"), (F.col("y") - F.coalesce("ty", F.lit(0.0))).alias("y"))


def overlaps(px: DataFrame, maxt: int, step: int = 1) -> DataFrame:
    """(frame, sx, sy, n): cell pixels that each shift of the grid lays on cell pixels of the frame before; zeros too.

    Pixels of a shift meet the earlier frame's by place, counted before they leave.
    """
    steps = F.array(*[F.lit(k) for k in range(-maxt, maxt + 1, step)])
    on = px.where("label > 0").select("frame", "x", "y")
    grid = px.select("frame").distinct().where("frame > 0").withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    moved = on.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps)).select("frame", "sx", "sy", (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"))
    n = moved.join(on.withColumn("frame", F.col("frame") + 1), ["frame", "x", "y"]).groupBy("frame", "sx", "sy").agg(F.count("*").alias("n"))
    return grid.join(n, ["frame", "sx", "sy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def best_overlap(px: DataFrame, maxt: int, step: int = 1) -> DataFrame:
    """Each frame's shift with the most overlap with the frame before; ties to the smaller shift in y, then x."""
    best = overlaps(px, maxt, step).groupBy("frame").agg(F.min(F.struct((-F.col("n")).alias("n"), "sy", "sx")).alias("k"))
    return best.select("frame", F.col("k.sx").alias("sx"), F.col("k.sy").alias("sy"), (-F.col("k.n")).alias("n"))


def image_shape(px: DataFrame, channels: list[str]) -> DataFrame:
    """(frame, axes, nx, ny, nz, n_channels) from pixel rows; z is an axis where the table has it, c where there are channels."""
    z = "z" in px.columns
    axes = ("z" if z else "") + "xy" + ("c" if channels else "")
    nz = F.max("z") + 1 if z else F.lit(1)
    return px.groupBy("frame").agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny"), nz.alias("nz")).select("frame", F.lit(axes).alias("axes"), "nx", "ny", "nz", F.lit(len(channels)).alias("n_channels"))


def foreground(px: DataFrame, mask: str | None = None, channel: str | None = None, threshold: float | None = None, stored: str = "foreground") -> DataFrame:
    """(frame, x, y, fg): a mask's labels over 0, else a channel over a threshold, else the stored foreground; null counts as not."""
    if mask is not None:
        on = F.col(mask) > 0
    elif channel is not None and threshold is not None:
        on = F.col(channel) > threshold
    else:
        on = F.col(stored).cast("boolean")
    return px.select("frame", "x", "y", F.coalesce(on, F.lit(False)).alias("fg"))


def _parts4(px: DataFrame, group: Column) -> DataFrame:
    return components(px, group, [(1, 0), (-1, 0), (0, 1), (0, -1)])


def probability_mask(px: DataFrame, channel: str, pcut: float = 0.8, holefill: int = 0, growth: int = 0) -> DataFrame:
    """(frame, x, y, on): a channel over pcut, parts of fewer than holefill pixels gone, then holes of fewer filled, then grown and shrunk by growth sides.

    Parts and holes hold together at sides. For a flat opening or closing by
    area it is the same to cut at pcut before as after.
    """
    out = px.select("frame", "x", "y", F.coalesce(F.col(channel) > pcut, F.lit(False)).alias("on"))
    if holefill:
        for kind in (True, False):
            parts = _parts4(out, F.when(F.col("on") == kind, F.lit(1)))
            small = parts.groupBy("frame", "part").agg(F.count("*").alias("n")).where(F.col("n") < holefill)
            turned = parts.join(small, ["frame", "part"], "left_semi").select("frame", "x", "y", F.lit(True).alias("_t"))
            out = materialize(out.join(turned, ["frame", "x", "y"], "left").select("frame", "x", "y", (F.col("on") != F.coalesce("_t", F.lit(False))).alias("on")), "mask")
    cross = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))]))
    for k in range(2 * growth):
        near = out.select("frame", "on", "x", "y", cross.alias("s")).select("frame", (F.col("x") + F.col("s.a")).alias("x"), (F.col("y") + F.col("s.b")).alias("y"), "on")
        agg = (F.max if k < growth else F.min)(F.col("on"))
        out = near.groupBy("frame", "x", "y").agg(agg.alias("on")).join(out.select("frame", "x", "y"), ["frame", "x", "y"], "left_semi")
    return out


def border_profile(px: DataFrame, channel: str, depth: int = 2) -> DataFrame:
    """Mean of a channel by ring inside each label's border: ring 0 is the border, 1 what is the border without it, and so on."""
    own, out = px, None
    for k in range(depth + 1):
        ring = borders(own).join(px.select("frame", "x", "y", channel), ["frame", "x", "y"])
        mean = ring.groupBy("frame", "label").agg(F.avg(channel).alias("value")).withColumn("ring", F.lit(k))
        out = mean if out is None else out.unionByName(mean)
        gone = borders(own).select("frame", "x", "y", F.lit(1).alias("_b"))
        own = own.join(gone, ["frame", "x", "y"], "left").withColumn("label", F.when(F.col("_b") == 1, 0).otherwise(F.col("label"))).drop("_b")
    return out.select("frame", "label", "ring", "value")
