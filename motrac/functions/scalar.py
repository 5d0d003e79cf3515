"""Column functions: pair forces, contact, vectors, images, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dist_to_contact(r: Column, r0: float, d0: float, n: int = 6, m: int = 12) -> Column:
    """1 under d0, else (1 - w^n) / (1 - w^m) with w = (r - d0) / r0; NaN at w = 1."""
    w = (r - d0) / r0
    ratio = F.when(w == 1, F.lit(float("nan"))).otherwise((1 - F.pow(w, F.lit(n))) / (1 - F.pow(w, F.lit(m))))
    return F.when(r < d0, F.lit(1.0)).otherwise(ratio)


def yukawa_force(r: Column, eps: float, R: float = 1.0) -> Column:
    """Null at r = 0."""
    return F.try_divide(eps * F.exp(-r / R) * (r + R), R * r * r)


def lj_force(r: Column, eps: float, R: float = 1.0, max_repulsion: bool = True) -> Column:
    """Lennard-Jones force with its minimum at R; distances under sigma count as sigma."""
    sigma = R / 2 ** (1 / 6)
    r = F.greatest(r, F.lit(sigma)) if max_repulsion else r
    return 48 * eps * (sigma**12 / F.pow(r, F.lit(13)) - 0.5 * sigma**6 / F.pow(r, F.lit(7)))


def morse_force(r: Column, eps: float, R: float = 1.0, L: float = 4.0, textbook: bool = False) -> Column:
    """The second exponent is positive unless textbook is set."""
    return eps * (F.exp(-2 * (r - R) / L) - F.exp((-1 if textbook else 1) * (r - R) / L))


def flux_ligdist(df: DataFrame, v: Column, cmean: float = 1.0, csigma: float = 0.5, center: bool = True) -> DataFrame:
    """Adds mean and sigma of a flux in proportion to a ligand density, the mean centred over all rows if asked."""
    out = df.withColumn("mean", cmean * v).withColumn("sigma", F.abs(csigma * F.abs(v)))
    if center:
        out = out.crossJoin(F.broadcast(df.agg(F.avg(cmean * v).alias("_middle")))).withColumn("mean", F.col("mean") - F.col("_middle")).drop("_middle")
    return out


def ternary_coords(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    total = a + b + c
    safe = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return 0.5 * (2 * b + c) / safe, (3**0.5 / 2) * c / safe


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def znorm(v: Column, *by: str) -> Column:
    """(v - mean) / population standard deviation, NaN left out of both; null where all values are equal."""
    w = Window.partitionBy(*by)
    known = F.when(~F.isnan(v), v)
    return F.try_divide(v - F.avg(known).over(w), F.stddev_pop(known).over(w))


def rescale_to_int(v: Column, *by: str, maxint: int = 65535) -> Column:
    """Whole numbers from 0 for the least value to maxint for the largest; null where all values are equal."""
    w = Window.partitionBy(*by)
    return F.floor(F.try_divide(maxint * (v - F.min(v).over(w)), F.max(v).over(w) - F.min(v).over(w))).cast("int")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows that have both; null where either is constant or none has."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def make_odd(x: Column) -> Column:
    """The smallest odd number at least x."""
    return (F.ceil((x + 1) / 2) * 2 - 1).cast("long")


def tile_index(row: Column, col: Column, nrows: int, ncols: int, snake: bool = False) -> Column:
    """The tile at a row (from the top) and column, numbered from the bottom row up."""
    up = nrows - 1 - row
    across = F.when(up % 2 == 1, ncols - 1 - col).otherwise(col) if snake else col
    return up * ncols + across


def time_stamp_seconds(name: Column) -> Column:
    """Seconds of the first ??d??h??m in a file name; null without one."""
    pattern = r"(\d\d)d(\d\d)h(\d\d)m"
    part = [F.when(name.rlike(pattern), F.regexp_extract(name, pattern, k)).cast("int") for k in (1, 2, 3)]
    return part[0] * 86400 + part[1] * 3600 + part[2] * 60


def fov_number(name: Column, position: int, length: int = 2) -> Column:
    """The number in a fixed part of a file name, other characters dropped."""
    return F.regexp_replace(F.substring(name, position + 1, length), "[^0-9]", "").cast("int")


def affine_2d(theta: Column, tx: Column, ty: Column, cx: float, cy: float, scale: float = 1.0) -> list[Column]:
    """Row-major 3 by 3 matrix: turn and scale about (cx, cy), then shift."""
    a, b = scale * F.cos(theta), scale * F.sin(theta)
    return [a, -b, cx - a * cx + b * cy + tx, b, a, cy - b * cx - a * cy + ty, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
