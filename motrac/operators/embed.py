"""Distances, neighbours, clusters, principal components, diffusion maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motrac.functions.scalar import distance
from motrac.sources.scratch import materialize


#: Rows of either side that a task compares at once.
BLOCK = 512

KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _blocks(points: DataFrame, name: str, block: int, dealt) -> DataFrame:
    """Points in blocks of about block rows, a row each, as lists of numbers and vectors, dealt over as many partitions as dealt makes of their number; rows without a vector are left out."""
    rows = points.where("xf is not null").select("cell_id", "xf")
    n = max(1, -(-rows.count() // block))
    placed = rows.withColumn("_n", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    return placed.groupBy("_n").agg(F.collect_list(F.struct("cell_id", "xf")).alias(name)).select(name).repartition(dealt(n))


def _unpacked(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = block.flatten()
    return rows.field("cell_id").to_numpy(), np.asarray(rows.field("xf").flatten().to_numpy(), float).reshape(len(rows), -1)


def _between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each vector of x to each of y."""
    d = np.empty((len(x), len(y)))
    for at in range(0, len(x), 32):
        d[at : at + 32] = np.sqrt(((x[at : at + 32, None] - y[None]) ** 2).sum(2))
    return d


def by_blocks(a: DataFrame, b: DataFrame, function, schema: str, block: int = BLOCK, merge=None) -> DataFrame:
    """What function makes of each block of a with each block of b, given numbers of a, of b, and their distances.

    Every row of a is compared with every row of b, as distances are asked for.
    Each side is written once, in partitions of a few blocks, and partitions meet
    as a product, which reads them and writes nothing; pairs of blocks would be the
    input times the number of blocks. What comes out is up to function. merge, if
    given, makes one result of two that a task has for the same block of a.
    """
    out = pa.schema([(n, KINDS[k]) for n, k in (field.split() for field in schema.split(","))])

    def run(batches):
        held, own = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                (i, x), (j, y) = (_unpacked(batch.column(c).slice(k, 1)) for c in (0, 1))
                new = function(i, j, _between(x, y))
                if merge and own is not None and np.array_equal(i, own):
                    held = merge(held, new)
                else:
                    if held is not None:
                        yield pa.RecordBatch.from_pandas(held, out, preserve_index=False)
                    held, own = new, i
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, out, preserve_index=False)

    left = _blocks(a, "a", block, lambda n: max(min(n, 64), -(-n // 4)))
    right = _blocks(b, "b", block, lambda n: -(-n // 16))
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def distance_rows(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, j, d) of every row of a with every row of b; an empty side gives an empty result."""
    return by_blocks(a, b, lambda i, j, d: pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "d": d.ravel()}), "i long, j long, d double", block)


def knn(queries: DataFrame, points: DataFrame, k: int, itself: bool = False, block: int = BLOCK) -> DataFrame:
    """The k nearest points of each query, itself left out unless asked for; ties to the smaller number. A task gives the k nearest of all its blocks only."""

    def nearest(i, j, d):
        at = np.argsort(j, kind="stable")
        j, d = j[at], d[:, at]
        if not itself:
            d = np.where(i[:, None] == j[None, :], np.inf, d)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"i": np.repeat(i, best.shape[1]), "j": j[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel()})
        return out[np.isfinite(out["d"])]

    def merge(one, two):
        both = pd.concat([one, two]).sort_values(["i", "d", "j"], ignore_index=True)
        return both[both.groupby("i").cumcount() < k]

    near = by_blocks(queries, points, nearest, "i long, j long, d double", block, merge)
    w = Window.partitionBy("i").orderBy("d", "j")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def store_distances(dist: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows (i, j, d) of a distance matrix in a folder; rows of an i that is there already are an error unless overwrite is set.

    Folders hold ranges of i, and overwriting replaces whole rows of the matrix only.
    """
    placed = dist.withColumn("part", F.floor(F.col("i") / BLOCK)).repartition("part")
    from pyspark.errors import AnalysisException

    try:
        old = dist.sparkSession.read.parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        known = old.join(dist.select("i").distinct(), "i", "left_semi")
        if not overwrite and known.head(1):
            raise ValueError("rows are stored already")
        kept = old.join(dist.select("i").distinct(), "i", "left_anti").select(*placed.columns)
        placed = materialize(kept.unionByName(placed), "distances")
    placed.write.mode("overwrite").partitionBy("part").parquet(path)


def load_distances(spark, path: str, symmetrize: bool = True) -> DataFrame:
    """Stored rows (i, j, d); symmetrized, d is the mean of both directions, a missing one left out."""
    d = spark.read.parquet(path).select("i", "j", "d")
    if not symmetrize:
        return d
    both = d.unionByName(d.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.avg("d").alias("d"))


#: What store_points keeps: rows with the call that stored them, and columns; a row meets the columns of its set.
ROWS, COLUMNS = "cell_id long, xf array<double>, set int, version int", "cell_id long, xf array<double>, set int"


def store_points(a: DataFrame, b: DataFrame, path: str, overwrite: bool = False) -> None:
    """The distances of the rows of a to the rows of b in a folder, as the vectors that give them; rows that are there already are an error unless overwrite is set.

    What lies there grows with the rows and not with their square: no distance is
    written, load_points makes them. Columns that are there already are not written
    again. Overwriting replaces whole rows of the matrix only: of rows stored more
    than once the last ones hold. Rows without a vector are left out.
    """
    from pyspark.errors import AnalysisException

    spark = a.sparkSession
    rows, columns = (side.where("xf is not null").select(F.col("cell_id").cast("long").alias("cell_id"), F.col("xf").cast("array<double>").alias("xf")) for side in (a, b))
    if columns.isEmpty():
        rows = rows.limit(0)
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("cell_id", "xf").cast("decimal(38,0)")).alias("mark")]
    version, k, alike = 0, 0, []
    try:
        old, sets = spark.read.schema(ROWS).parquet(f"{path}/rows"), spark.read.schema(COLUMNS).parquet(f"{path}/columns")
    except AnalysisException:
        old = None
    if old is not None:
        if not overwrite and old.join(rows.select("cell_id").distinct(), "cell_id", "left_semi").head(1):
            raise ValueError("rows are stored already")
        version = old.agg(F.coalesce(F.max("version") + 1, F.lit(0))).first()[0]
        known, new = sets.groupBy("set").agg(*marks).collect(), columns.agg(*marks).first()
        k = max([-1, *(x["set"] for x in known)]) + 1
        alike = [x["set"] for x in known if (x["n"], x["mark"]) == tuple(new) and columns.exceptAll(sets.where(F.col("set") == x["set"]).drop("set")).isEmpty()]
    if not alike:
        columns.withColumn("set", F.lit(k)).write.mode("append").parquet(f"{path}/columns")
    rows.withColumns({"set": F.lit(alike[0] if alike else k), "version": F.lit(version)}).write.mode("append").parquet(f"{path}/rows")


def load_points(spark, path: str, symmetrize: bool = True, block: int = BLOCK // 2) -> DataFrame:
    """(i, j, d) of rows that store_points has stored; symmetrized, d is the mean of both directions, a missing one left out.

    Numbers stand in blocks with all their vectors, those of their rows and of their
    columns, and each two blocks meet once, in a product that writes nothing: there
    both directions of a pair are made together. Blocks are half of those elsewhere, as
    their numbers hold two vectors.
    """
    out = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("d", pa.float64())])

    def unpacked(block):
        numbers = block.flatten()
        vectors = numbers.field("xf").flatten()
        owner = np.repeat(np.arange(len(numbers)), numbers.field("xf").value_lengths().to_numpy())
        x = np.asarray(vectors.field("xf").flatten().to_numpy(), float).reshape(len(vectors), -1)
        return numbers.field("cell_id").to_numpy(), owner, vectors.field("row").to_numpy(zero_copy_only=False), vectors.field("set").to_numpy(), x

    def directed(a, b):
        """Places in a, places in b and distances of the rows of a to the columns of b, set by set."""
        (_, i, row, k, x), (_, j, other, m, y) = a, b
        for one in np.unique(k[row]):
            p, q = np.flatnonzero(row & (k == one)), np.flatnonzero(~other & (m == one))
            yield i[p], j[q], _between(x[p], y[q])

    def mean(a, b):
        s, n = np.zeros((2, len(a[0]), len(b[0])))
        for i, j, d in [*directed(a, b), *((i, j, d.T) for j, i, d in directed(b, a))]:
            at = np.ix_(i, j)
            if len(np.unique(i)) == len(i) and len(np.unique(j)) == len(j):
                s[at] += d
                n[at] += 1
            else:
                np.add.at(s, at, d)
                np.add.at(n, at, 1)
        i, j = np.nonzero(n)
        return i, j, s[i, j] / n[i, j]

    def rows(i, j, d):
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(d)], schema=out)

    def run(batches):
        for batch in batches:
            for c in range(batch.num_rows):
                a, b = (unpacked(batch.column(name).slice(c, 1)) for name in "ab")
                same = batch.column("m")[c].as_py() == batch.column("n")[c].as_py()
                if symmetrize:
                    i, j, d = mean(a, b)
                    i, j = a[0][i], b[0][j]
                    yield rows(i, j, d)
                    if not same:
                        yield rows(j, i, d)
                else:
                    for p, q in [(a, b), (b, a)][: 1 if same else 2]:
                        for i, j, d in directed(p, q):
                            yield rows(np.repeat(p[0][i], len(j)), np.tile(q[0][j], len(i)), d.ravel())

    held = spark.read.schema(ROWS).parquet(f"{path}/rows").withColumn("_last", F.max("version").over(Window.partitionBy("cell_id"))).where("version = _last")
    columns = spark.read.schema(COLUMNS).parquet(f"{path}/columns")
    sides = [side.select("cell_id", F.struct(F.lit(row).alias("row"), "set", "xf").alias("v")) for side, row in ((held, True), (columns, False))]
    numbers = sides[0].unionByName(sides[1]).groupBy("cell_id").agg(F.collect_list("v").alias("xf"))
    n = max(1, -(-numbers.count() // block))
    placed = numbers.groupBy(F.pmod(F.xxhash64("cell_id"), F.lit(n)).alias("n")).agg(F.collect_list(F.struct("cell_id", "xf")).alias("b"))
    left = placed.select(F.col("n").alias("m"), F.col("b").alias("a")).repartition(max(min(n, 64), -(-n // 4)))
    right = placed.select("n", "b").repartition(-(-n // 16))
    return left.join(right.hint("shuffle_replicate_nl"), F.col("m") <= F.col("n")).mapInArrow(run, "i long, j long, d double")


def distance_variance(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """(i, var): the population variance of each row's distances to all rows of b, from sums by block."""

    def sums(i, j, d):
        m = d.mean(1)
        return pd.DataFrame({"i": i, "n": len(j), "m": m, "s": ((d - m[:, None]) ** 2).sum(1)})

    part = by_blocks(a, b, sums, "i long, n long, m double, s double", block)
    total = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("s").alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    return total.select("i", ((F.col("s") + F.col("q") - F.col("t") * F.col("t") / F.col("n")) / F.col("n")).alias("var"))


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Each point's nearest centre; ties to the smaller cluster. Centres are few and stand in one broadcast row."""
    one = centers.agg(F.collect_list(F.struct("cluster", "center")).alias("cs"))
    d = F.transform("cs", lambda c: F.struct(distance(F.col("xf"), c["center"]).alias("d"), c["cluster"].alias("cluster")))
    return points.crossJoin(F.broadcast(one)).select("cell_id", F.array_min(d).alias("k")).select("cell_id", "k.cluster", "k.d")


def mean_centers(points: DataFrame, by: str) -> DataFrame:
    """The mean vector of each group, in an aggregation that is combined before the shuffle."""
    flat = points.select(F.col(by).alias("cluster"), F.posexplode("xf").alias("k", "v")).groupBy("cluster", "k").agg(F.avg("v").alias("v"))
    return flat.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("center"))


def kmeans(points: DataFrame, k: int, seed: int = 0):
    """Spark's k-means over xf: (model, points with cluster)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.withColumn("features", array_to_vector("xf"))
    model = KMeans(k=k, seed=seed).fit(v)
    return model, model.transform(v).select("cell_id", F.col("prediction").alias("cluster"))


def pca(points: DataFrame, var_cutoff: float = 0.95, dim: int | None = None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(scores, axes, shares): the fewest principal components that explain var_cutoff of the variance, or dim of them.

    The covariance of d columns is summed by partitions; d squared numbers reach
    the driver. Rows without a vector get no score; without any vector, or where
    all are equal, there are no axes and each score is empty.
    """
    first = points.where("xf is not null").select("xf").first()
    d = len(first[0]) if first else 0
    none = points.select("cell_id", F.array().cast("array<double>").alias("x")), np.zeros((d, 0)), np.zeros(0)
    if not first:
        return none

    def sums(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            x = np.stack(pdf["xf"].to_numpy())
            n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        yield pd.DataFrame({"v": [np.concatenate([[n], s, g.ravel()])]})

    total = np.zeros(1 + d + d * d)
    for r in points.where("xf is not null").select("xf").mapInPandas(sums, "v array<double>").toLocalIterator():
        total += np.array(r["v"])
    n, mean, g = total[0], total[1 : 1 + d] / total[0], total[1 + d :].reshape(d, d)
    cov = g / n - np.outer(mean, mean)
    w, v = np.linalg.eigh(cov)
    w, v = np.maximum(w[::-1], 0), v[:, ::-1]
    if w.sum() <= 0:
        return none
    share = w / w.sum()
    k = dim or int(np.searchsorted(np.cumsum(share), var_cutoff) + 1)
    axes = v[:, :k] * np.sign(v[np.abs(v[:, :k]).argmax(0), np.arange(k)])

    @F.pandas_udf("array<double>")
    def score(xf: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(xf.to_numpy()) - mean) @ axes))

    return points.where("xf is not null").select("cell_id", score("xf").alias("x")), axes, share[:k]


def segment_features(segs: DataFrame, points: DataFrame, key: str = "traj_id") -> DataFrame:
    """Each segment's vectors end to end, in order."""
    e = segs.select(key, "pos", F.posexplode("cell_ids").alias("k", "cell_id")).join(points.select("cell_id", "xf"), "cell_id")
    return e.groupBy(key, "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "xf"))), lambda s: s["xf"])).alias("xf"), F.count("*").alias("n"))


def diffusion_kernel(points: DataFrame, sigma: float, nn: int) -> DataFrame:
    """(i, j, p): Gaussian weights of each row's nn nearest (itself among them), rows scaled to one."""
    a = knn(points, points, nn, itself=True).withColumn("a", F.exp(-F.col("d") * F.col("d") / (2 * sigma)))
    return a.select("i", "j", (F.col("a") / F.sum("a").over(Window.partitionBy("i"))).alias("p"))


def diffusion_map(p: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors after the constant one, each divided by it."""
    w, v = np.linalg.eig(p)
    order = np.argsort(-w.real)[: k + 1]
    v = v[:, order].real
    return v[:, 1:] / v[:, :1]


def _leading(apply, n: int, count: int, most: int = 400, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of a real matrix with the largest real parts, and their vectors, from its products with columns alone.

    Block Arnoldi: the basis grows by a block of count vectors a step, so that equal
    eigenvalues are all found, and starts again from the best ones when it has most
    columns. It ends when each residual is under 1e-10; else that is an error.
    """
    basis = np.random.default_rng(0).normal(size=(n, count))
    for _ in range(rounds):
        q = np.linalg.qr(basis)[0]
        image = np.empty((n, 0))
        while True:
            new = apply(q[:, image.shape[1] :])
            image = np.concatenate([image, new], axis=1)
            h = q.T @ image
            w, y = np.linalg.eig(h)
            order = np.argsort(-w.real, kind="stable")[:count]
            w, y = w[order], y[:, order]
            if np.linalg.norm(image @ y - (q @ y) * w, axis=0).max() < 1e-10:
                return w, q @ y
            if q.shape[1] + count > min(n, most):
                break
            for _ in range(2):
                new = new - q @ (q.T @ new)
            q = np.concatenate([q, np.linalg.qr(new)[0]], axis=1)
        ritz = q @ y
        basis = np.concatenate([ritz.real, ritz.imag], axis=1)[:, : 2 * count] + 1e-12 * np.random.default_rng(1).normal(size=(n, 2 * count))
    raise ArithmeticError("the leading eigenvectors did not settle")


def sparse_diffusion_map(i: np.ndarray, j: np.ndarray, p: np.ndarray, n: int, k: int) -> np.ndarray:
    """diffusion_map of the matrix that has p at (i, j) and zeros elsewhere; its numbers are kept, not the square of n."""
    if n <= 1000:
        dense = np.zeros((n, n))
        dense[i, j] = p
        return diffusion_map(dense, k)
    w, v = _leading(lambda x: np.stack([np.bincount(i, p * c[j], n) for c in x.T], axis=1), n, k + 1)
    top = v[np.abs(v).argmax(0), np.arange(k + 1)]
    v = (v * (np.abs(top) / top)).real  # each vector's largest entry is real, as LAPACK leaves it
    return v[:, 1:] / v[:, :1]


def prune(x: np.ndarray, rcut: float = 5.0) -> np.ndarray:
    """Rows whose coordinates all lie within rcut standard deviations, looked at until none goes."""
    keep = np.ones(len(x), bool)
    while True:
        z = np.abs(x - x[keep].mean(0)) / np.maximum(x[keep].std(0), 1e-300)
        new = keep & (z < rcut).all(1)
        if (new == keep).all():
            return keep
        keep = new


def sigma_curve(points: DataFrame, eps: list[float], block: int = BLOCK) -> DataFrame:
    """ln of the kernel summed over all pairs of rows for each bandwidth, from sums by block."""
    part = by_blocks(points, points, lambda i, j, d: pd.DataFrame({"eps": eps, "s": [float(np.exp(-d * d / (2 * e)).sum()) for e in eps]}), "eps double, s double", block)
    return part.groupBy("eps").agg(F.log(F.sum("s")).alias("log_sum"))


def scaled_sigma(curve: list[tuple[float, float]]) -> tuple[float, float]:
    """(bandwidth, dimension) from (eps, log_sum): where ln of the sum rises steepest against ln eps, and twice that slope."""
    e, s = np.log([c[0] for c in sorted(curve)]), np.array([c[1] for c in sorted(curve)])
    slope = np.gradient(s, e)
    k = int(slope.argmax())
    return float(np.exp(e[k])), float(2 * slope[k])
