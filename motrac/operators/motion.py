"""Displacements, motility, time correlations, pair distributions, registration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from motrac.functions.scalar import dot
from motrac.operators.lineage import pairs_within
from motrac.sources.scratch import materialize


def displacements(cells: DataFrame) -> DataFrame:
    """Adds dx, dy from the parent; null without one."""
    p = cells.select(F.col("cell_id").alias("parent_id"), F.col("x").alias("_px"), F.col("y").alias("_py"))
    return cells.join(p, "parent_id", "left").withColumn("dx", F.col("x") - F.col("_px")).withColumn("dy", F.col("y") - F.col("_py")).drop("_px", "_py").select(*cells.columns, "dx", "dy")


def _unit(df: DataFrame, prefix: str = "") -> DataFrame:
    n = F.sqrt(F.col(f"{prefix}dx") * F.col(f"{prefix}dx") + F.col(f"{prefix}dy") * F.col(f"{prefix}dy"))
    n = F.when(n > 0, n)
    return df.withColumn(f"{prefix}ux", F.col(f"{prefix}dx") / n).withColumn(f"{prefix}uy", F.col(f"{prefix}dy") / n)


#: Width of a tile in radii, rows of a tile that one task has for its own, rows in a partition, and rows and others that are compared at once.
TILE, OWN, DEALT, STEP, OTHERS = 8, 65536, 16384, 64, 4096

PLACE = ["frame", "tx", "ty", "part"]


def _sent(own: DataFrame, rmax: float) -> DataFrame:
    """Rows in the tiles that they are in or nearer to than rmax, which tells the former by own.

    A tile of more than OWN rows is dealt over parts: each has all its rows, and
    some of them for its own. Tiles that are so are few, and stand in a broadcast.
    """
    width, reach = TILE * rmax, 1.001 * rmax
    tile = lambda c: F.floor(c / width)
    many = own.groupBy("frame", tile(F.col("x")).alias("tx"), tile(F.col("y")).alias("ty")).agg(F.ceil(F.count("*") / OWN).alias("parts")).where("parts > 1")
    out = own.withColumns({"hx": tile(F.col("x")), "hy": tile(F.col("y"))})
    for c in ("x", "y"):
        out = out.withColumn(f"t{c}", F.explode(F.sequence(tile(F.col(c) - reach), tile(F.col(c) + reach))))
    out = out.join(F.broadcast(many), ["frame", "tx", "ty"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    mine = (F.col("tx") == F.col("hx")) & (F.col("ty") == F.col("hy")) & (F.pmod(F.xxhash64("cell_id"), "parts") == F.col("part"))
    return out.select(*PLACE, "cell_id", "x", "y", "ux", "uy", mine.alias("own"))


def _groups(batches):
    """Rows of one tile and part after the other, as they come sorted."""
    held = []
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in PLACE]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(at, end - at)
            if held and part.num_rows and any(held[0].column(c)[0] != part.column(c)[0] for c in PLACE):
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _meetings(rows: pa.Table, rmax: float):
    """The pairs of a tile's own rows with its rows, sorted by x: the tile's frame and arrays by name, some pairs at a time."""
    ids, x, y, ux, uy = (rows.column(c).to_numpy() for c in ("cell_id", "x", "y", "ux", "uy"))
    moved, mine = rows.column("ux").is_valid().to_numpy(), np.flatnonzero(rows.column("own").to_numpy())
    for at in range(0, len(mine), STEP):
        own = mine[at : at + STEP]
        first, last = np.searchsorted(x, x[own[0]] - 1.001 * rmax), np.searchsorted(x, x[own[-1]] + 1.001 * rmax, "right")
        for k in range(first, last, OTHERS):
            e = min(k + OTHERS, last)
            dx, dy = x[own, None] - x[None, k:e], y[own, None] - y[None, k:e]
            d = np.sqrt(dx * dx + dy * dy)
            at_own, at_other = np.nonzero((d < rmax) & (d > 0) & (ids[own, None] != ids[None, k:e]))
            d, dx, dy, i, j = d[at_own, at_other], dx[at_own, at_other], dy[at_own, at_other], own[at_own], at_other + k
            none = ~(moved[i] & moved[j])
            alpha = (ux[i] - ux[j]) * (dx / d) + (uy[i] - uy[j]) * (dy / d)
            yield {"frame": pa.repeat(rows.column("frame")[0], len(i)), "cell_id": ids[i], "b_cell_id": ids[j], "d": d, "alpha": pa.array(alpha, mask=none), "beta": pa.array(ux[i] * ux[j] + uy[i] * uy[j], mask=none)}


def alignments(moving: DataFrame, rmax: float, columns: tuple[str, ...] = ("frame", "cell_id", "b_cell_id", "d", "alpha", "beta")) -> DataFrame:
    """Ordered pairs of one frame nearer than rmax: cell_id, b_cell_id, d, alpha, beta.

    beta is the product of the unit displacements, alpha their difference along
    the separation; both null where a displacement is absent or zero. The rows
    that meet are written once, with no more than a pair needs, and go to their
    tile of TILE radii and to those whose edge is near; there all their pairs are
    made, some at a time, and leave one after the other. A tile is held in memory.
    """
    here = [F.abs(c) < float("inf") for c in ("x", "y")]
    number = lambda c: F.col(c).cast("double").alias(c)
    own = materialize(_unit(moving).where("frame is not null and cell_id is not null").where(here[0] & here[1]).select("cell_id", "frame", *map(number, ("x", "y", "ux", "uy"))), "moving")
    kind = StructType([*own.select("frame", "cell_id").schema, *own.select(F.col("cell_id").alias("b_cell_id"), F.lit(0.0).alias("d"), F.col("ux").alias("alpha"), F.col("uy").alias("beta")).schema])
    kind = StructType([kind[c] for c in columns])
    schema = to_arrow_schema(kind)

    def run(batches):
        for rows in _groups(batches):
            for found in _meetings(rows, rmax):
                yield pa.RecordBatch.from_arrays([pa.array(found[c]).cast(schema.field(c).type) for c in columns], schema=schema)

    dealt = _sent(own, rmax).repartition(max(1, -(-own.count() // DEALT)), *PLACE).sortWithinPartitions(*PLACE, "x")
    return dealt.mapInArrow(run, kind)


def motility(moving: DataFrame, rmax: float) -> DataFrame:
    """cell_id, speed, alpha, beta: means over neighbours; null without a parent, 0 without neighbours."""
    a = alignments(moving, rmax).groupBy("cell_id").agg(F.avg("alpha").alias("_a"), F.avg("beta").alias("_b"))
    speed = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    zero = lambda c: F.when(F.col("dx").isNotNull(), F.coalesce(c, F.lit(0.0)))
    return moving.join(a, "cell_id", "left").select("cell_id", speed.alias("speed"), zero(F.col("_a")).alias("alpha"), zero(F.col("_b")).alias("beta"))


def _lagged(series: DataFrame, value: Column, min_length: int) -> DataFrame:
    """Means of value by lag over origins and lags below half of each trajectory longer than min_length.

    Each row is joined with the origins that reach it by position, so a
    trajectory's pairs are made where its rows are.
    """
    n = F.count("*").over(Window.partitionBy("traj_id"))
    s = series.withColumn("n", n).where(F.col("n") > min_length).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    origin = s.where("pos < half").select("traj_id", "half", *[F.col(c).alias(f"a_{c}") for c in series.columns if c != "traj_id"]).withColumn("lag", F.explode(F.expr("sequence(0, half - 1)"))).withColumn("pos", F.col("a_pos") + F.col("lag"))
    return origin.join(series, ["traj_id", "pos"]).withColumn("v", value).where("v is not null and not isnan(v)").groupBy("lag").agg(F.avg("v").alias("value"), F.count("*").alias("n"))


def tcf(series: DataFrame, min_length: int = 2) -> DataFrame:
    """Time correlation of x and y: mean dot product by lag."""
    return _lagged(series.select("traj_id", "pos", "x", "y"), F.col("a_x") * F.col("x") + F.col("a_y") * F.col("y"), min_length)


def msd(series: DataFrame, min_length: int = 1) -> DataFrame:
    """Mean squared displacement by lag."""
    d = (F.col("x") - F.col("a_x")) * (F.col("x") - F.col("a_x")) + (F.col("y") - F.col("a_y")) * (F.col("y") - F.col("a_y"))
    return _lagged(series.select("traj_id", "pos", "x", "y"), d, min_length)


def dx_tcf(moving: DataFrame, min_length: int = 1) -> DataFrame:
    """Time correlation of displacements by lag."""
    return _lagged(moving.select("traj_id", "pos", "dx", "dy"), F.col("a_dx") * F.col("dx") + F.col("a_dy") * F.col("dy"), min_length)


def _edges(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)]


def _bin(d: Column, low: float, high: float, n: int) -> Column:
    """The number of the half-open bin that holds d among n even edges, from 1; 0 under the first edge, n from the last on.

    A division finds the bin and a look at its two edges, made by the formula of
    _edges, corrects what it rounds.
    """
    k = F.least(F.greatest(F.floor((d - low) / ((high - low) / (n - 1))) + 1, F.lit(0)), F.lit(n)).cast("int")
    edge = lambda i: low + F.lit(high - low) * i / F.lit(n - 1)
    return F.when((k > 0) & (d < edge(k - 1)), k - 1).when((k < n) & (d >= edge(k)), k + 1).otherwise(k)


def _inside(binned: DataFrame, n: int) -> DataFrame:
    """Rows whose bin lies between the first and the last of n edges.

    The bins meet a list of numbers: a filter would move through the aggregation
    into the join of pairs, where the bin would be worked out again.
    """
    bins = binned.sparkSession.range(1, n).select(F.col("id").cast("int").alias("bin"))
    return binned.join(F.broadcast(bins), "bin")


def pair_rdf(a: DataFrame, b: DataFrame, rmax: float = 500.0, nr: int = 50) -> DataFrame:
    """Radial distribution of ordered pairs in a frame: bin, r (upper edge), n, g.

    g = n / (2 pi r dr), times the volume of all bins over the number of pairs; null without pairs.
    """
    edges = _edges(1e-6, rmax, nr)
    n = pairs_within(a, b, rmax, [("frame", "frame")]).groupBy(_bin(F.col("d"), 1e-6, rmax, nr).alias("bin")).agg(F.count("*").alias("n"))
    grid = a.sparkSession.createDataFrame([(k, edges[k], 2 * math.pi * edges[k] * (edges[k] - edges[k - 1])) for k in range(1, nr)], "bin int, r double, vol double")
    g = F.broadcast(grid).join(n, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    every = Window.partitionBy()
    return g.select("bin", "r", "n", F.try_divide(F.col("n") / F.col("vol") * F.sum("vol").over(every), F.sum("n").over(every)).alias("g"))


def pair_cluster_rdf(a: DataFrame, same: str, rmax: float = 500.0, nr: int = 50) -> DataFrame:
    """The share of pairs in each radial bin whose column `same` agrees."""
    p = pairs_within(a, a, rmax, [("frame", "frame")]).groupBy(_bin(F.col("d"), 1e-6, rmax, nr).alias("bin"))
    return _inside(p.agg(F.count("*").alias("n"), F.avg((F.col(same) == F.col(f"b_{same}")).cast("double")).alias("share")), nr)


def dx_rdf(moving: DataFrame, rmax: float = 100.0, nr: int = 8) -> DataFrame:
    """Displacement correlation by separation: the mean over frames of each frame's mean product."""
    p = pairs_within(moving.where("dx is not null"), moving.where("dx is not null"), rmax, [("frame", "frame")])
    p = p.groupBy(_bin(F.col("d"), 0.0, rmax, nr).alias("bin"), "frame").agg(F.avg(F.col("dx") * F.col("b_dx") + F.col("dy") * F.col("b_dy")).alias("v"))
    return _inside(p.groupBy("bin").agg(F.avg("v").alias("value"), F.count("*").alias("n_frames")), nr)


def _shares(n: DataFrame) -> DataFrame:
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def dx_theta(moving: DataFrame, rcut: float = 100.0, nth: int = 10) -> DataFrame:
    """Shares of angles between displacements of unordered pairs nearer than rcut, in half-open bins of 0..pi.

    The product is taken before it is divided by the lengths. For opposite moves
    rounding decides whether the angle is pi, which no bin holds, or just under it,
    so the order of the divisions is part of the result.
    """
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    m = moving.where("dx is not null and (dx <> 0 or dy <> 0)").select("cell_id", "frame", "x", "y", "dx", "dy", length.alias("n"))
    p = pairs_within(m, m, rcut, [("frame", "frame")]).where("cell_id > b_cell_id")
    cosine = F.try_divide(F.try_divide(F.col("dx") * F.col("b_dx") + F.col("dy") * F.col("b_dy"), F.col("n")), F.col("b_n"))
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return _shares(_inside(p.groupBy(_bin(theta, 0.0, math.pi, nth).alias("bin")).agg(F.count("*").alias("n")), nth))


def dx_alpha(moving: DataFrame, rcut: float = 40.0, nth: int = 10) -> DataFrame:
    """Shares of alpha over ordered pairs nearer than rcut, in half-open bins of -2..2."""
    bins = F.when(F.col("alpha").isNotNull(), _bin(F.col("alpha"), -2.0, 2.0, nth)).alias("bin")
    return _shares(_inside(alignments(moving, rcut).groupBy(bins).agg(F.count("*").alias("n")), nth))


def signal_contributions(cells: DataFrame, signal: str, rmax: float = 5.0, scale: float = 1.0) -> DataFrame:
    """Each cell's sum of its neighbours' signal over distance, distances in units of scale."""
    p = pairs_within(cells, cells, rmax * scale, [("frame", "frame")]).where("d > 0")
    return p.groupBy("cell_id").agg(F.sum(F.try_divide(F.col(f"b_{signal}") * scale, F.col("d"))).alias("received"), F.count("*").alias("n"))


def centred_mean(series: DataFrame, value: str, width: int, key: str = "traj_id") -> DataFrame:
    """Adds mean and n: of a value over the frames from width before a row's to just under width after, within its trajectory."""
    w = Window.partitionBy(key).orderBy("frame").rangeBetween(-width, width - 1)
    return series.withColumn("mean", F.avg(value).over(w)).withColumn("n", F.count(value).over(w))


def vector_tcf(series: DataFrame, min_length: int = 1) -> DataFrame:
    """Time correlation of vectors xf by lag: the mean dot product within each trajectory."""
    return _lagged(series.select("traj_id", "pos", "xf"), dot(F.col("a_xf"), F.col("xf")), min_length)


def _contact_sums(moving: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cell_id, speed, alpha, beta) from pairs that carry both sides' x, y, ux and uy, the other's prefixed o_, and n."""
    d = F.sqrt((F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y")))
    alpha = F.try_divide((F.col("ux") - F.col("o_ux")) * (F.col("x") - F.col("o_x")) + (F.col("uy") - F.col("o_uy")) * (F.col("y") - F.col("o_y")), d)
    beta = F.col("ux") * F.col("o_ux") + F.col("uy") * F.col("o_uy")
    weighted = lambda v: F.sum(F.coalesce(v * F.col("n"), F.lit(0.0))) / F.sum("n")
    s = pairs.groupBy("cell_id").agg(weighted(alpha).alias("a"), weighted(beta).alias("b"))
    has = F.col("dx").isNotNull()
    speed = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return moving.join(s, "cell_id", "left").select("cell_id", speed.alias("speed"), F.when(has, F.coalesce("a", F.lit(0.0))).alias("alpha"), F.when(has, F.coalesce("b", F.lit(0.0))).alias("beta"))


def contact_motility(moving: DataFrame, contacts: DataFrame) -> DataFrame:
    """(cell_id, speed, alpha, beta): alpha and beta of touching cells, weighted by their share of the contact; null without a parent.

    contacts: (cell_id, other_id, n). Pairs without a direction count as zero.
    """
    own = _unit(moving).select("cell_id", "x", "y", "dx", "dy", "ux", "uy")
    side = own.select("cell_id", "x", "y", "ux", "uy")
    other = side.select(*[F.col(c).alias("other_id" if c == "cell_id" else f"o_{c}") for c in side.columns])
    return _contact_sums(own, side.join(contacts, "cell_id").join(other, "other_id"))


def near_motility(moving: DataFrame, coord: str, reach: float, share: Column) -> DataFrame:
    """contact_motility where cells of one frame touch whose coord differs by reach at most; share is the first cell's column n.

    A frame's pairs grow with the square of its cells: each is made where both
    cells' rows are and leaves as a part of its cell's sums, so no pair is moved.
    """
    own = materialize(_unit(moving).select("cell_id", "frame", "x", "y", "dx", "dy", "ux", "uy", F.col(coord).cast("double").alias("_c"), share.alias("n")), "moving")
    strip = F.floor(F.col("_c") / (reach * (1 + 1e-9))).cast("long")  # a little wider, as divisions round
    a = own.select("cell_id", "frame", "x", "y", "ux", "uy", "_c", "n", F.explode(F.sequence(strip - 1, strip + 1)).alias("_g"))
    b = own.select(F.col("frame").alias("_f"), *[F.col(c).alias(f"o_{c}") for c in ("cell_id", "x", "y", "ux", "uy", "_c")], strip.alias("_h"))
    touch = (F.col("cell_id") != F.col("o_cell_id")) & (F.abs(F.col("_c") - F.col("o__c")) <= reach)
    return _contact_sums(own, a.hint("merge").join(b.hint("merge"), [F.col("frame") == F.col("_f"), F.col("_g") == F.col("_h")]).where(touch))


def point_registration(centers: DataFrame) -> DataFrame:
    """(frame, tx, ty): the shift of the least-squares turn, scale and shift that takes a frame's centres to their nearest ones before; zero for the first frame or a single point.

    The fit comes from eight sums by frame.
    """
    now = centers.select("frame", "label", "x", "y")
    before = centers.select((F.col("frame") + 1).alias("frame"), F.col("label").alias("_l"), F.col("x").alias("u"), F.col("y").alias("v"))
    d = (F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    near = now.join(before, "frame").groupBy("frame", "label", "x", "y").agg(F.min(F.struct(d.alias("d"), "_l", "u", "v")).alias("k")).select("frame", "x", "y", "k.u", "k.v")
    x, y, u, v = (F.col(c) for c in "xyuv")
    s = near.groupBy("frame").agg(*[F.avg(c).alias(f"m{c}") for c in "xyuv"], F.avg(x * x + y * y).alias("s"), F.avg(x * u + y * v).alias("c"), F.avg(x * v - y * u).alias("w"))
    mx, my, mu, mv = (F.col(f"m{c}") for c in "xyuv")
    spread = F.col("s") - mx * mx - my * my
    a, b = (F.try_divide(top, F.when(spread > 1e-9, spread)) for top in (F.col("c") - mx * mu - my * mv, F.col("w") - mx * mv + my * mu))
    fit = s.select("frame", (mu - a * mx + b * my).alias("tx"), (mv - b * mx - a * my).alias("ty"))
    return centers.select("frame").distinct().join(fit, "frame", "left").select("frame", F.coalesce("tx", F.lit(0.0)).alias("tx"), F.coalesce("ty", F.lit(0.0)).alias("ty"))


def registration_expansion(shifts: DataFrame, nx: int, ny: int) -> DataFrame:
    """(frame, tx, ty, nx, ny): shifts from their least value and centred by half the largest, and the size that holds all shifted images."""
    low = shifts.agg(*[f(c).alias(f"_{k}{c}") for c in ("tx", "ty") for k, f in (("a", F.min), ("b", F.max))])
    wide = lambda c: F.col(f"_b{c}") - F.col(f"_a{c}")
    moved = lambda c: F.col(c) - F.col(f"_a{c}") - wide(c) / 2
    return shifts.crossJoin(F.broadcast(low)).select("frame", moved("tx").alias("tx"), moved("ty").alias("ty"), F.floor(nx + wide("tx")).cast("int").alias("nx"), F.floor(ny + wide("ty")).cast("int").alias("ny"))


def contact_shift_sum(tile: DataFrame, field: DataFrame, nx: int, ny: int, rp: float, nt: int) -> DataFrame:
    """(i, j, value): for each shift of a grid over an image, how well a tile's centres meet those of the image, less the mean around.

    A shift's value is the mean contact of the tile's shifted centres with the
    nearest of the image's centres within the tile's extent, both ways counted
    as the first; it is zero where there are none, or where some of the mean's
    window has none. The window is int(2 rp) wide and mirrored at the edges.
    """
    from motrac.functions.scalar import dist_to_contact

    box = tile.agg((F.max("x") - F.min("x")).alias("wx"), (F.max("y") - F.min("y")).alias("wy"), F.count("*").alias("m"))
    size = (nx / (nt - 1), ny / (nt - 1))
    grid = tile.sparkSession.range(nt * nt).select((F.col("id") % nt).cast("int").alias("i"), F.floor(F.col("id") / nt).cast("int").alias("j"))
    shifted = grid.crossJoin(F.broadcast(box)).select("i", "j", "wx", "wy", "m", (F.col("i") * size[0]).alias("sx"), (F.col("j") * size[1]).alias("sy"))
    f = field.select(F.col("x").alias("fx"), F.col("y").alias("fy"))
    inside = (F.col("fx") > F.col("sx")) & (F.col("fx") < F.col("sx") + F.col("wx")) & (F.col("fy") > F.col("sy")) & (F.col("fy") < F.col("sy") + F.col("wy"))
    seen = shifted.join(f, inside).crossJoin(F.broadcast(tile.select("label", "x", "y")))
    r = F.sqrt((F.col("x") + F.col("sx") - F.col("fx")) ** 2 + (F.col("y") + F.col("sy") - F.col("fy")) ** 2)
    near = seen.groupBy("i", "j", "m", "label").agg(F.min(r).alias("r"))
    value = near.withColumn("c", dist_to_contact(F.col("r"), rp / 2, rp / 2)).groupBy("i", "j", "m").agg((2 * F.sum(F.when(~F.isnan("c"), F.col("c"))) / F.first("m")).alias("s"))
    width = int(2 * rp)
    low, high = -(width // 2), width - 1 - width // 2
    fold = lambda c: F.when(F.pmod(c, F.lit(2 * nt)) < nt, F.pmod(c, F.lit(2 * nt))).otherwise(2 * nt - 1 - F.pmod(c, F.lit(2 * nt)))
    offsets = F.explode(F.sequence(F.lit(low), F.lit(high)))
    window = grid.withColumn("a", offsets).withColumn("b", offsets).select("i", "j", fold(F.col("i") + F.col("a")).alias("p"), fold(F.col("j") + F.col("b")).alias("q"))
    around = window.join(value.select(F.col("i").alias("p"), F.col("j").alias("q"), "s"), ["p", "q"], "left").groupBy("i", "j").agg(F.when(F.count("s") == F.count("*"), F.avg("s")).alias("mean"))
    return around.join(value.select("i", "j", "s"), ["i", "j"], "left").select("i", "j", F.coalesce(F.col("s") - F.col("mean"), F.lit(0.0)).alias("value"))


def shift_costs(centers: DataFrame, maxt: float, ntrans: int) -> DataFrame:
    """For each frame and each shift of a grid, the two-way sum of nearest distances to the frame before.

    centers: frame, x, y, one row a cell and few of them a frame; each frame is
    compared with its own predecessor only.
    """
    steps = [-maxt + 2 * maxt * k / (ntrans - 1) for k in range(ntrans)]
    shifts = F.array(*map(F.lit, steps))
    now = centers.select("frame", F.col("x").alias("bx"), F.col("y").alias("by"))
    before = centers.select((F.col("frame") + 1).alias("frame"), "x", "y")
    d = F.sqrt(F.pow(F.col("x") + F.col("sx") - F.col("bx"), F.lit(2)) + F.pow(F.col("y") + F.col("sy") - F.col("by"), F.lit(2)))
    p = before.join(now, "frame").withColumn("sx", F.explode(shifts)).withColumn("sy", F.explode(shifts)).withColumn("d", d)
    one = p.groupBy("frame", "sx", "sy", "x", "y").agg(F.min("d").alias("m"))
    two = p.groupBy("frame", "sx", "sy", "bx", "by").agg(F.min("d").alias("m"))
    return one.select("frame", "sx", "sy", "m").unionByName(two.select("frame", "sx", "sy", "m")).groupBy("frame", "sx", "sy").agg(F.sum("m").alias("cost"))


def stack_shifts(centers: DataFrame, maxt: float = 10.0, ntrans: int = 20) -> DataFrame:
    """Registration: each frame's cheapest shift (ties to the smaller) and the sum of all up to it, starting at zero."""
    best = shift_costs(centers, maxt, ntrans).groupBy("frame").agg(F.min(F.struct(F.round("cost", 9).alias("c"), "sx", "sy")).alias("k"))
    frames = centers.select("frame").distinct().join(best, "frame", "left")
    w = Window.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.select("frame", F.sum(F.coalesce(-F.col("k.sx"), F.lit(0.0))).over(w).alias("tx"), F.sum(F.coalesce(-F.col("k.sy"), F.lit(0.0))).over(w).alias("ty"))
