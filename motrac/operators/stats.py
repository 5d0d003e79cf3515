"""Regression, batch matching, bulk profiles, histograms."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motrac.functions.scalar import correlation
from motrac.sources.scratch import materialize


def linear_coef(df: DataFrame, y: Column, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """Least squares y = ca a + cb b without a constant, from five sums; null where a and b are in proportion."""
    s = df.groupBy(*(by or [])).agg(F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    return s.select(*(by or []), F.try_divide(F.col("bb") * F.col("ay") - F.col("ab") * F.col("by"), det).alias("ca"), F.try_divide(F.col("aa") * F.col("by") - F.col("ab") * F.col("ay"), det).alias("cb"))


def histogram(df: DataFrame, v: str, low: float, high: float, n: int) -> DataFrame:
    """Counts in n equal bins, half-open but for the last, which is closed."""
    k = F.least(F.floor((F.col(v) - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")
    return df.where(F.col(v).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def batch_normalization(batch0: DataFrame, batch1: DataFrame, nbins: int = 100, stdcut: float = 5.0) -> tuple[float, float]:
    """(a, b) so that values of batch 0 are near a times matched values of batch 1 plus b.

    Outliers over stdcut standard deviations go; both are put in common bins,
    each bin's cumulated share is matched between the batches, and one is regressed
    on the other with batch 0's counts as weights. Only nbins counts of either
    batch reach the driver. Nulls are left out; where a batch has no value or all
    values that stay are in one bin, both results are NaN.
    """
    batch0, batch1 = (b.where("v is not null and not isnan(v)") for b in (batch0, batch1))
    s = [b.agg(F.avg("v"), F.stddev_pop("v")).first() for b in (batch0, batch1)]
    if any(m is None for m, _ in s):
        return float("nan"), float("nan")
    kept = [b.where((F.abs(F.col("v") - m) < stdcut * sd) | F.lit(sd == 0)) for b, (m, sd) in zip((batch0, batch1), s)]
    ranges = [k.agg(F.min("v"), F.max("v")).first() for k in kept]
    low, high = min(r[0] for r in ranges), max(r[1] for r in ranges)
    if high <= low:
        return float("nan"), float("nan")
    count = []
    for k in kept:
        c = np.zeros(nbins)
        for r in histogram(k, "v", low, high, nbins).collect():
            c[r["bin"]] = r["n"]
        count.append(c)
    mid = low + (np.arange(nbins) + 0.5) * (high - low) / nbins
    cdf = [np.cumsum(c) / c.sum() for c in count]
    match = mid[np.abs(cdf[1][None, :] - cdf[0][:, None]).argmin(1)]
    w = count[0]
    mx, my = np.average(match, weights=w), np.average(mid, weights=w)
    spread = float((w * (match - mx) ** 2).sum())
    if spread <= 0:
        return float("nan"), float("nan")
    a = float((w * (match - mx) * (mid - my)).sum() / spread)
    return a, float(my - a * mx)


def prefix_sum(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """Adds the sum of value over all rows up to each in the given order, and their sum in all as name_total.

    Rows are dealt by ranges of the order; each range adds up its own, and the
    sums of the ranges before it, one row a range, go on top.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = placed.groupBy("_range").agg(F.sum(value).alias("_own"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).crossJoin(sums.agg(F.sum("_own").alias(f"{name}_total"))).drop("_own")
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(every, "_range").withColumn(name, F.col("_before") + F.sum(value).over(w)).drop("_range", "_before")


def credible_level(df: DataFrame, p: str) -> DataFrame:
    """1 less the cumulated share in ascending order of p, so the densest row gets 0."""
    return prefix_sum(df, p, [p, "bin"], "_sum").withColumn("level", 1 - F.try_divide(F.col("_sum"), F.col("_sum_total"))).drop("_sum", "_sum_total")


def wide(long: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """A row for each key with a column for each given name: its value there, null where there is none, the largest of several."""
    return long.groupBy(*key).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names])


def mesh_average(df: DataFrame, v: str, x: str, y: str, width: float) -> DataFrame:
    """Sum of v over count plus one, in square bins."""
    return df.groupBy(F.floor(F.col(x) / width).cast("int").alias("ix"), F.floor(F.col(y) / width).cast("int").alias("iy")).agg((F.sum(v) / (F.count("*") + 1)).alias("value"))


def predicted_fc(probs: DataFrame, states_fc: DataFrame) -> DataFrame:
    """(condition, gene, fc): state shares times the states' profiles, summed."""
    return probs.join(states_fc, "state").groupBy("condition", "gene").agg(F.sum(F.col("p") * F.col("fc")).alias("fc"))


def bounded_lsq(a: np.ndarray, b: np.ndarray, lb: float = 0.0, ub: float = np.inf, iters: int = 5000) -> np.ndarray:
    """min |a x - b| with lb <= x <= ub: each coordinate is solved in turn until nothing moves."""
    g, h, x = a.T @ a, a.T @ b, np.clip(np.zeros(a.shape[1]), lb, ub)
    for _ in range(iters):
        old = x.copy()
        for k in range(len(x)):
            if g[k, k] > 0:
                x[k] = min(max(x[k] + (h[k] - g[k] @ x) / g[k, k], lb), ub)
        if np.abs(x - old).max() < 1e-14:
            break
    return x


def state_decomposition(profiles: DataFrame, probs: pd.DataFrame, npermutations: int = 500, seed: int = 0, lb: float = 0.0, ub: float = float("inf")) -> DataFrame:
    """(gene, state, fc): for each gene the mean over subsets of conditions of the bounded least-squares profile.

    probs is the small table of conditions by states; profiles (condition, gene,
    fc) is grouped by gene, a row for each condition. Conditions that probs does
    not have, and null values, are left out; one that a gene lacks counts as zero.
    """
    n_states = probs.shape[1]
    if n_states > len(probs):
        raise ValueError("more states than conditions")
    subsets = list(combinations(range(len(probs)), n_states))
    rng = np.random.default_rng(seed)
    if len(subsets) > npermutations:
        subsets = [subsets[k] for k in rng.choice(len(subsets), npermutations, replace=False)]
    names, p = list(probs.columns), probs.to_numpy(float)
    at = {c: i for i, c in enumerate(probs.index)}

    profiles = profiles.where(F.col("condition").isin(list(at)) & F.col("fc").isNotNull())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(len(at))
        x[[at[c] for c in pdf["condition"]]] = pdf["fc"].to_numpy(float)
        fc = np.mean([bounded_lsq(p[list(s)], x[list(s)], lb, ub) for s in subsets], axis=0)
        return pd.DataFrame({"gene": pdf["gene"].iloc[0], "state": names, "fc": fc})

    return profiles.groupBy("gene").applyInPandas(one, "gene string, state string, fc double")


def log_correlation(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Pearson correlation of log2 a and log2 b, rows with a zero left out."""
    return df.where((F.col(a) > 0) & (F.col(b) > 0)).groupBy(by).agg(correlation(F.log2(a), F.log2(b)).alias("corr"))


def null_correlations(profiles: DataFrame, states_fc: DataFrame, conditions: list[str], nrandom: int = 500, seed: int = 0) -> DataFrame:
    """(draw, condition, corr): profiles against predictions from random state shares; draws are made by rows of hashed numbers."""
    spark = profiles.sparkSession
    states = [r[0] for r in states_fc.select("state").distinct().orderBy("state").collect()]
    u = lambda s: (F.pmod(F.xxhash64(F.lit(seed), "draw", "condition", F.lit(s)), F.lit(1 << 30)) + 1) / float(1 << 30)
    draws = spark.range(nrandom).select(F.col("id").alias("draw"), F.explode(F.array(*map(F.lit, conditions))).alias("condition"))
    total = sum((u(s) for s in states), F.lit(0.0))
    probs = draws.select("draw", "condition", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), (u(s) / total).alias("p")) for s in states])).alias("k")).select("draw", "condition", "k.*")
    pred = probs.join(states_fc, "state").groupBy("draw", "condition", "gene").agg(F.sum(F.col("p") * F.col("fc")).alias("null_fc"))
    return pred.join(profiles, ["condition", "gene"]).where("null_fc > 0 and fc > 0").groupBy("draw", "condition").agg(correlation(F.log2("null_fc"), F.log2("fc")).alias("corr"))
