"""Markov models of state sequences: counts, probabilities, entropies, committors, spectra.

Counts are made by Spark. A matrix over states is small by its nature; functions
that need all of it at once collect at most max_states squared rows and say so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motrac.sources.scratch import materialize


def state_steps(series: DataFrame, nlag: int = 1) -> DataFrame:
    """(traj_id, pos, i, j): the state at a position and nlag positions later."""
    w = Window.partitionBy("traj_id").orderBy("pos")
    return series.select("traj_id", "pos", F.col("state").alias("i"), F.lead("state", nlag).over(w).alias("j")).where("j is not null")


def transition_counts(steps: DataFrame) -> DataFrame:
    return steps.groupBy("i", "j").agg(F.count("*").alias("n"))


def transition_matrix(steps: DataFrame, n_states: int) -> DataFrame:
    """Dense (i, j, p): rows add to one, a state without departures stays."""
    grid = steps.sparkSession.range(n_states).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n_states - 1))).alias("j"))
    counted = grid.join(transition_counts(steps), ["i", "j"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("i"))
    return counted.select("i", "j", F.when(total > 0, F.col("n") / total).otherwise((F.col("i") == F.col("j")).cast("double")).alias("p"))


def coarse_grain(steps: DataFrame, states: DataFrame) -> DataFrame:
    """Steps between clusters as steps between the states that (cluster, state) maps them to."""
    a = states.select(F.col("cluster").alias("i"), F.col("state").alias("si"))
    b = states.select(F.col("cluster").alias("j"), F.col("state").alias("sj"))
    return steps.join(a, "i").join(b, "j").select(F.col("si").alias("i"), F.col("sj").alias("j"))


def path_entropy(steps: DataFrame, matrix: DataFrame, exclude_stays: bool = False, weighted: bool = False) -> DataFrame:
    """Mean of -ln p (or -p ln p) over observed steps with p > 0; null if none."""
    s = steps.where("i <> j") if exclude_stays else steps
    p = s.join(matrix, ["i", "j"]).where("p > 0")
    return p.agg(F.avg(-F.log("p") * (F.col("p") if weighted else F.lit(1.0))).alias("entropy"))


def path_ll(steps: DataFrame, matrix: DataFrame, exclude_stays: bool = False) -> DataFrame:
    s = steps.where("i <> j") if exclude_stays else steps
    return s.join(matrix, ["i", "j"]).where("p > 0").agg(F.avg(F.log("p")).alias("ll"))


def traj_gmean(steps: DataFrame, matrix: DataFrame, exclude_stays: bool = False, reverse: bool = False) -> DataFrame:
    """Each trajectory's geometric mean of transition probabilities, forward or of the reversed path."""
    s = steps.where("i <> j") if exclude_stays else steps
    if reverse:
        s = s.select("traj_id", F.col("j").alias("i"), F.col("i").alias("j"))
    return s.join(matrix, ["i", "j"]).where("p > 0").groupBy("traj_id").agg(F.exp(F.avg(F.log("p"))).alias("gmean"))


def entropy_production(steps: DataFrame, matrix: DataFrame) -> DataFrame:
    """Mean over trajectories of ln(forward / reversed geometric mean), both positive."""
    f, r = traj_gmean(steps, matrix), traj_gmean(steps, matrix, reverse=True).withColumnRenamed("gmean", "back")
    return f.join(r, "traj_id").where("gmean > 0 and back > 0").agg(F.avg(F.log(F.col("gmean") / F.col("back"))).alias("entropy_production"))


def avdx_clusters(centers: DataFrame, matrix: DataFrame) -> DataFrame:
    """Each cluster's mean displacement of centres: the sum of p times (x_j - x_i)."""
    a = centers.select(F.col("cluster").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = centers.select(F.col("cluster").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    p = matrix.join(a, "i").join(b, "j")
    return p.groupBy(F.col("i").alias("cluster")).agg(F.sum((F.col("xj") - F.col("xi")) * F.col("p")).alias("dx"), F.sum((F.col("yj") - F.col("yi")) * F.col("p")).alias("dy"))


def committor_steps(matrix: DataFrame, targets: list[int], source: list[int], n_steps: int) -> DataFrame:
    """The committor after a fixed number of sweeps, with DataFrames only; each sweep joins the sparse matrix with q.

    Targets are one, sources zero; for matrices too large for one machine.
    """
    q = matrix.select(F.col("i").alias("state")).distinct().withColumn("q", F.col("state").isin(targets).cast("double"))
    for k in range(n_steps):
        new = matrix.join(q.withColumnRenamed("state", "j"), "j").groupBy(F.col("i").alias("state")).agg(F.sum(F.col("p") * F.col("q")).alias("q"))
        q = new.withColumn("q", F.when(F.col("state").isin(targets), 1.0).when(F.col("state").isin(source), 0.0).otherwise(F.col("q")))
        if k % 5 == 4:
            q = materialize(q, "committor")
    return q


def dense(matrix: DataFrame, max_states: int = 2000) -> np.ndarray:
    """The matrix on the driver; refuses more than max_states states."""
    n = (matrix.agg(F.greatest(F.max("i"), F.max("j"))).first()[0] or 0) + 1
    if n > max_states:
        raise ValueError(f"{n} states exceed max_states={max_states}")
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r["i"], r["j"]] = r["p"]
    return out


def committor(m: np.ndarray, targets: list[int], source: list[int], conv: float = 1e-3) -> np.ndarray:
    """q = Mq to a summed change of at most conv, source rows absorbing, one on targets and zero on sources."""
    m, q = m.copy(), np.zeros(len(m))
    m[source] = 0
    m[source, source] = 1
    before = q
    while True:
        q[targets], q[source] = 1, 0
        q = m @ q
        if np.abs(q - before).sum() <= conv:
            break
        before = q.copy()
    q[targets], q[source] = 1, 0
    return q


def steady_state(m: np.ndarray, conv: float = 1e-3, most: int = 10_000) -> np.ndarray:
    """The mean row of powers of m, looked at each tenth power until it changes by at most conv in sum."""
    power, p = m.copy(), m.mean(0)
    for k in range(2, most + 1):
        power = m @ power
        if k % 10 == 0:
            new = power.mean(0) / power.mean(0).sum()
            change, p = np.abs(new - p).sum(), new
            if change <= conv:
                break
    return p


def kscore(m: np.ndarray, eps: float = 1e-3) -> float:
    """Sum of 1 / (1 - w) over the real parts 0 < w < 1 of all eigenvalues that are not one, if one is an eigenvalue, else NaN; absorbing rows are left out."""
    keep = np.diag(m) < 1
    w = np.linalg.eigvals(m[np.ix_(keep, keep)]).real
    if not len(w) or not (np.abs(w - 1) < eps).any():
        return float("nan")
    real = w[(w > 0) & (w < 1) & (np.abs(w - 1) > eps)]
    return float((1 / (1 - real)).sum())


def hermitian_eigs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors of (M + M') / 2 + i (M - M') / 2."""
    return np.linalg.eigh((m + m.T) / 2 + 0.5j * (m - m.T))


def motifs(v: np.ndarray, ncomp: int, w: np.ndarray | None = None) -> np.ndarray:
    """Real and imaginary parts of the last ncomp vectors side by side, weighted if asked."""
    last = v[:, -ncomp:] * (1 if w is None else w[-ncomp:])
    return np.concatenate([last.real, last.imag], axis=1)


def largest_component(matrix: DataFrame) -> DataFrame:
    """The states of the largest weakly connected part of p > 0, ties to the part with the smallest state; min labels spread in rounds."""
    e = matrix.where("p > 0 and i <> j").select("i", "j")
    e = materialize(e.unionByName(e.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "edges")
    labels = matrix.select(F.col("i").alias("state")).distinct().withColumn("c", F.col("state"))
    before = None
    while True:
        near = e.join(labels, e["j"] == labels["state"]).groupBy("i").agg(F.min("c").alias("m"))
        labels = materialize(labels.join(near, labels["state"] == near["i"], "left").select("state", F.least("c", F.coalesce("m", "c")).alias("c")), "labels")
        total = labels.agg(F.sum("c")).first()[0]
        if total == before:
            break
        before = total
    size = labels.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(1)
    return labels.join(F.broadcast(size), "c").select("state")


def kmeans(x: np.ndarray, k: int, seed: int = 0, iters: int = 50) -> np.ndarray:
    """Labels by Lloyd's iterations from a spread-out start; for coordinates of states, not of cells."""
    rng = np.random.default_rng(seed)
    centers = x[rng.integers(len(x))][None]
    while len(centers) < k:
        d = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
        centers = np.concatenate([centers, x[[int(d.argmax())]]])
    for _ in range(iters):
        label = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.array([x[label == c].mean(0) if (label == c).any() else centers[c] for c in range(k)])
    return label


def kinetic_states(v: np.ndarray, n_final: int, n_initial: int | None = None, pcut: float = 0.01, seed: int = 0, max_states: int = 100) -> np.ndarray:
    """Clusters of coordinates with k growing until n_final hold over pcut of the rows; rows of others go to the nearest row outside."""
    if (n_initial or n_final) > max_states:
        raise ValueError("n_initial exceeds max_states")
    for k in range(n_initial or n_final, max_states + 1):
        label = kmeans(v, min(k, len(v)), seed)
        share = np.bincount(label, minlength=k) / len(label)
        if (share > pcut).sum() >= n_final or k >= len(v):
            break
    least = np.sort(share)[::-1][n_final - 1]
    out, first = label.copy(), label.copy()
    for s in np.flatnonzero((share < least) & (share > 0)):
        for row in np.flatnonzero(first == s):
            others = np.flatnonzero(first != s)
            out[row] = out[others[((v[others] - v[row]) ** 2).sum(1).argmin()]]
    return np.unique(out, return_inverse=True)[1]


def to_frame(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"state int, {name} double")
