"""Toxicity as an ordinal grade: a cumulative-link model over sparse text features.

Features are the words of a text and the first 3 to 6 letters of longer ones,
with the logarithm of their counts as values. Those that toxic and other texts
of a bounded labelled sample share unequally are kept. Labels say only whether a
text is toxic; a toxic text's grade, 1 to GRADES, is the third that it falls in
by how many words it has that only toxic texts have. One weight per feature
serves all thresholds: P(grade <= k) = logistic(theta_k - w x), thetas ascending.
The result is the expected grade, and a text is toxic if grade 1 or more is
likelier than not.

Edge cases: null and empty texts have no features and the grade of the lowest
threshold; repeated rows get the same grade; without toxic labels every severity
is 0; a labels table with several rows for one doc_id counts as toxic if any is;
where rows repeat a labelled doc_id, the model learns from the least of their texts;
other columns are kept by filter_toxic and ignored by score_toxicity.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import chunk_codes, documents, held, materialize, text_blocks

#: Labelled texts of either kind that the model may be fitted on, features kept, and texts that a feature needs.
MAX_TOXIC, MAX_CLEAN, MAX_FEATURES, LEAST = 4000, 8000, 3000, 2
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def features_of(chunk: str, known: dict[str, tuple[int, ...]]) -> tuple[int, ...]:
    """Hashes of a chunk's words and their beginnings."""
    got = known.get(chunk)
    if got is None:
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in _WORD.findall(chunk.lower()):
            out.append(zlib.crc32(w.encode("utf-8", "surrogatepass")))
            out += [zlib.crc32(b"^" + w[:n].encode("utf-8", "surrogatepass")) for n in range(3, 7) if len(w) > n]
        got = known[chunk] = tuple(out)
    return got


def _counted(texts: pa.Array, chosen: dict[int, int] | None):
    """For each text its features' counts and its number of chunks; only chosen ones if given, by their numbers."""
    known = held("toxicity", dict)
    for lo, hi in text_blocks(texts):
        distinct, codes, offsets = chunk_codes(texts.slice(lo, hi - lo))
        each = [features_of(c, known) for c in distinct]
        if chosen is not None:
            each = [tuple([chosen[f] for f in e if f in chosen]) for e in each]
        some = np.array([bool(e) for e in each] or [False])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = codes[a:b]
            own = own[some[own]]
            values, counts = np.unique(own, return_counts=True)
            out: Counter = Counter()
            for c, k in zip(values.tolist(), counts.tolist()):
                for f in each[c]:
                    out[f] += k
            yield out, b - a


@dataclass
class ToxicityModel:
    chosen: dict[int, int]
    weights: np.ndarray
    theta: np.ndarray

    def severity(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the chance of grade 1 or more."""
        at = np.array([sum(self.weights[f] * np.log1p(k) for f, k in c.items()) for c, _ in _counted(texts, self.chosen)], float)
        if not len(self.theta):
            return np.zeros(len(at)), np.zeros(len(at))
        above = 1 / (1 + np.exp(-np.clip(at[:, None] - self.theta[None, :], -500, 500)))
        return above.sum(1), above[:, 0]


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, grades: int, l2: float = 0.1, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the proportional-odds model, by gradient steps with momentum of both kinds.

    The penalty on weights is l2 against the summed likelihood of all rows.
    Likelihood of a row of grade g: s(theta_g+1 - z) - s(theta_g - z); thresholds are a first one and positive gaps.
    """
    n = len(grade)
    params = np.concatenate([np.zeros(n_features), [2.0], np.zeros(grades - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, theta = params[:n_features], np.cumsum(np.concatenate([params[n_features : n_features + 1], np.exp(params[n_features + 1 :])]))
        z = np.bincount(doc, weights=w[feature] * value, minlength=n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        s = 1 / (1 + np.exp(-np.clip(edges[None, :] - z[:, None], -500, 500)))
        low, high = s[np.arange(n), grade], s[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-12)
        d_low, d_high = low * (1 - low), high * (1 - high)
        g_z = (d_high - d_low) / p / n
        g_theta = np.zeros(grades)
        for k in range(grades):
            g_theta[k] = ((d_low / p)[grade == k + 1].sum() - (d_high / p)[grade == k].sum()) / n
        grad = np.empty_like(params)
        grad[:n_features] = np.bincount(feature, weights=g_z[doc] * value, minlength=n_features) + l2 / n * w
        grad[n_features] = g_theta.sum()
        tails = np.cumsum(g_theta[::-1])[::-1]
        grad[n_features + 1 :] = tails[1:] * np.exp(params[n_features + 1 :])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:n_features], np.cumsum(np.concatenate([params[n_features : n_features + 1], np.exp(params[n_features + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_features: int = MAX_FEATURES) -> ToxicityModel:
    """The model of at most max_toxic toxic and max_clean other labelled texts, the first by a hash of doc_id."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect() for y, n in ((1, max_toxic), (0, max_clean))]
    sample = spark.createDataFrame([(r["doc_id"], r["y"]) for rows in first for r in rows], "doc_id long, y int")
    own = documents(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    own = materialize(own.select("y", "text"), "toxicity-sample")

    def count(batches):
        n: dict[int, list[int]] = {}
        for batch in batches:
            for y, (c, _) in zip(batch.column("y").to_pylist(), _counted(batch.column("text"), None)):
                for f in c:
                    n.setdefault(f, [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["f", "n0", "n1"])

    total = [0, 0]
    for r in own.groupBy("y").count().collect():
        total[r["y"]] = r["count"]
    if not total[1]:
        return ToxicityModel({}, np.zeros(0), np.zeros(0))
    a, b = F.col("n1") + 0.5, F.col("n0") + 0.5
    ratio = F.log(a / b) - float(np.log((total[1] + 1) / (total[0] + 1)))
    counted = own.mapInArrow(count, "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= LEAST)
    best = counted.withColumn("gain", F.abs(ratio) * F.sqrt(F.col("n0") + F.col("n1"))).where(F.abs(ratio) > 1).orderBy(F.desc("gain"), "f").limit(max_features).collect()
    chosen = {r["f"]: i for i, r in enumerate(best)}
    marked = {i for i, r in enumerate(best) if r["n1"] > 20 * (r["n0"] + 0.1) * total[1] / max(1, total[0])}

    def vectors(batches):
        for batch in batches:
            for y, (c, _) in zip(batch.column("y").to_pylist(), _counted(batch.column("text"), chosen)):
                hits = float(sum(k for f, k in c.items() if f in marked))
                yield pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([hits]), pa.array([list(c)], pa.list_(pa.int32())), pa.array([list(c.values())], pa.list_(pa.int32()))], names=["y", "hits", "f", "k"])

    rows = own.mapInArrow(vectors, "y int, hits double, f array<int>, k array<int>").collect()
    rows.sort(key=lambda r: (r["y"], r["hits"], sorted(zip(r["f"], r["k"]))))
    cuts = np.quantile([r["hits"] for r in rows if r["y"]] or [0.0], [k / GRADES for k in range(1, GRADES)])
    grade = np.array([1 + int(np.searchsorted(cuts, r["hits"], side="right")) if r["y"] else 0 for r in rows])
    doc = np.repeat(np.arange(len(rows)), np.array([len(r["f"]) for r in rows], np.int64))
    feature = np.array([f for r in rows for f in r["f"]], np.int64)
    value = np.log1p(np.array([k for r in rows for k in r["k"]], float))
    weights, theta = fit_ordinal(doc, feature, value, grade, len(chosen), GRADES)
    return ToxicityModel(chosen, weights, theta)


def scorer(model: ToxicityModel, spark):
    """A column function of a text column: struct of severity and chance."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("severity double, chance double")
    def score(texts: pa.Array) -> pa.Array:
        severity, chance = shared.value.severity(texts)
        return pa.StructArray.from_arrays([pa.array(severity), pa.array(chance)], names=["severity", "chance"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """One row per row of docs: doc_id, expected_severity (0 to GRADES), toxic_chance, toxic."""
    score = scorer(fit(docs, labels, **kw), docs.sparkSession)
    rows = documents(docs).select("doc_id", score("text").alias("s"))
    return rows.select("doc_id", F.col("s.severity").alias("expected_severity"), F.col("s.chance").alias("toxic_chance"), (F.col("s.chance") >= threshold).cast("int").alias("toxic"))


def filter_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **kw) -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    score = scorer(fit(docs, labels, **kw), docs.sparkSession)
    return docs.where(score(F.coalesce(F.col("text"), F.lit("")))["chance"] < threshold)
