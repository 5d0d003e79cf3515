"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are words, what chunks look like and how they repeat: the lower-cased word
in each chunk, the chunk's shape (letters, digits and marks, runs cut short), its
length, whether it repeats the chunk before or one seen before in the text, and
how often. A text is the square root of its terms' shares, weighted by rarity; the
terms that most texts of a bounded sample of labelled texts have are kept. A
truncated singular value decomposition of the sample gives the latent space, and
the sample's vectors with their labels are broadcast: max_train rows of rank
numbers. Every text is compared with all of them by blocked cosine products; the
k nearest vote with their similarity as weight.

The score reads the whole text and nothing else. Edge cases: null and empty
texts have a vector of their own (the term for no words) and a score; repeated
rows get the same score; where rows repeat a labelled doc_id, the model learns from
the least of their texts; without labelled rows every score is prior; other
columns are kept by filter_quality and ignored by score_quality.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import chunk_codes, documents, held, materialize, text_blocks

#: Labelled texts that the model may hold, terms of words and as many others, latent dimensions, neighbours.
MAX_TRAIN, MAX_TERMS, RANK, NEIGHBOURS = 3000, 512, 32, 25
THRESHOLD = 0.3
_RUNS = re.compile(r"(.)\1+")
#: Characters of a chunk that are shaped together, and symbols of a shape that make one term.
PIECE, SYMBOLS = 64, 12
#: What a word counts beside a shape: texts on one subject are near each other only where their looks are.
WORD = 0.01
#: Texts whose vectors are made together.
ROWS = 512
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def shapes(chunk: str):
    """The terms of a whole chunk's shape, one for each SYMBOLS symbols of each PIECE characters.

    Symbols are runs of upper and lower case, digits and each mark; a run of marks longer than one is doubled.
    """
    for i in range(0, len(chunk), PIECE):
        kinds = "".join(["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in chunk[i : i + PIECE]])
        kinds = _RUNS.sub(lambda m: m[1] if m[1] in "Aa0" else m[1] * 2, kinds)
        for k in range(0, len(kinds), SYMBOLS):
            yield sys.intern(f"s:{kinds[k : k + SYMBOLS]}")


def word_of(chunk: str) -> str | None:
    """The lower-cased letters of a chunk without the marks around them; None where other things are left."""
    word = chunk.strip(_MARKS)
    return word.lower() if word.isalpha() else None


def chunk_terms(chunk: str) -> list[tuple[str, float]]:
    """The terms of a chunk with their shares, one in all for each kind."""
    own, word = Counter(shapes(chunk)), word_of(chunk)
    n = own.total()
    return [*((t, k / n) for t, k in own.items()), (f"l:{len(chunk).bit_length()}", 1.0), *([(f"w:{word}", WORD)] if word else [])]


def repeat_terms(n: int, distinct: int, again: int, top: int, pairs: int) -> list[tuple[str, float]]:
    """The terms of a text of n chunks: how many are distinct, repeat the one before, are the most frequent one; and distinct pairs."""
    if not n:
        return [("none", 1.0)]
    out = [("again", again / n), (f"seen:{int((1 - distinct / n) * 10)}", 0.5), (f"top:{int(top / n * 10)}", 0.5), (f"size:{n.bit_length()}", 0.1)]
    return [*out, (f"pairs:{int((1 - pairs / (n - 1)) * 10)}", 0.5)] if n > 1 else out


class Terms:
    """Numbers of the terms that a model knows, and what of them remembered chunks have."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self.words = {t[2:]: i for t, i in ids.items() if t.startswith("w:")}
        self.known: dict[str, tuple[tuple[int, ...], tuple[float, ...]]] = {}
        #: What lower-case words that are no term of their own have, by their length's bits.
        self.plain = [self._of([("s:a", 1.0), (f"l:{k}", 1.0)]) for k in range(64)]

    def _of(self, terms) -> tuple[tuple[int, ...], tuple[float, ...]]:
        own = [(self.ids[t], v) for t, v in terms if t in self.ids]
        return tuple([i for i, _ in own]), tuple([v for _, v in own])

    def chunk(self, chunk: str) -> tuple[tuple[int, ...], tuple[float, ...]]:
        if chunk.isalpha() and chunk.islower() and chunk not in self.words:
            return self.plain[len(chunk).bit_length()]
        got = self.known.get(chunk)
        if got is None:
            got = self._of(chunk_terms(chunk))
            if len(chunk) <= PIECE:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[chunk] = got
        return got


def _blocks(texts: pa.Array):
    """(chunks of the block, codes without empty ones, their texts' places, number of texts), of ROWS texts at most."""
    for lo, hi in text_blocks(texts):
        for at in range(lo, hi, ROWS):
            n = min(ROWS, hi - at)
            distinct, codes, offsets = chunk_codes(texts.slice(at, n))
            row = np.repeat(np.arange(n), np.diff(offsets))
            full = np.array([bool(c) for c in distinct] or [True])[codes] if len(codes) else np.zeros(0, bool)
            yield distinct, codes[full].astype(np.int64), row[full], n


def _repeats(codes: np.ndarray, row: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each text the five numbers that repeat_terms takes."""
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = np.bincount(row, minlength=n)
    if len(codes):
        own, counts = np.unique(row * size + codes, return_counts=True)
        at = own // size
        out[:, 1] = np.bincount(at, minlength=n)
        np.maximum.at(out[:, 3], at, counts)
        same = row[1:] == row[:-1]
        out[:, 2] = np.bincount(row[1:][same & (codes[1:] == codes[:-1])], minlength=n)
        pair = np.unique(((row[1:] * size + codes[:-1]) * size + codes[1:])[same])
        out[:, 4] = np.bincount(pair // (size * size), minlength=n)
    return out


def text_terms(texts: pa.Array):
    """The terms of each text of an Arrow string array with their shares, in order: all terms, known to a model or not."""
    for distinct, codes, row, n in _blocks(texts):
        numbers = _repeats(codes, row, n, len(distinct) + 1)
        for i, own in enumerate(np.split(codes, np.cumsum(numbers[:-1, 0]))):
            out: Counter = Counter()
            for c, k in zip(*(x.tolist() for x in np.unique(own, return_counts=True))):
                for t, v in chunk_terms(distinct[c]):
                    out[t] += v * k / len(own)
            for t, v in repeat_terms(*numbers[i].tolist()):
                out[t] += v
            yield out


def term_rows(texts: pa.Array, terms: Terms):
    """Blocks of rows, a text each, of the shares of the terms that the model knows."""
    width = len(terms.ids)
    for distinct, codes, row, n in _blocks(texts):
        numbers = _repeats(codes, row, n, len(distinct) + 1)
        each = [terms.chunk(c) for c in distinct]
        sizes = np.fromiter((len(e[0]) for e in each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(e[0] for e in each), np.int64, int(sizes.sum()))
        share = np.fromiter(chain.from_iterable(e[1] for e in each), np.float64, int(sizes.sum()))
        k = sizes[codes]
        take = np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        at = np.repeat(row, k)
        out = np.bincount(at * width + ids[take], weights=share[take] / numbers[at, 0], minlength=n * width).reshape(n, width)
        for i, own in enumerate(numbers.tolist()):
            for t, v in repeat_terms(*own):
                if t in terms.ids:
                    out[i, terms.ids[t]] += v
        yield out


@dataclass
class QualityModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of shares to unit vectors of the latent space."""
        z = (np.sqrt(x) * self.idf) @ self.axes
        return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Votes for each row of shares."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        z, k = self.project(x), min(self.neighbours, len(self.labels))
        out = np.empty(len(z))
        for i in range(0, len(z), 256):
            cosine = z[i : i + 256] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 8 + 1e-9
            out[i : i + 256] = (w * self.labels[near]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS, rank: int = RANK, neighbours: int = NEIGHBOURS) -> QualityModel:
    """The model of a sample of at most max_train labelled texts, the first by a hash of doc_id; held-out rows are never read."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in sample.collect()], "doc_id long, y int")

    own = documents(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    own = materialize(own.select("y", "text"), "quality-sample")

    def count(batches):
        n: Counter = Counter()
        for batch in batches:
            for t in text_terms(batch.column("text")):
                n.update(t.keys())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["t", "n"])

    counted = own.mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))
    kinds = (F.col("t").startswith("w:"), ~F.col("t").startswith("w:"))
    chosen = [(r["t"], r["n"]) for k in kinds for r in counted.where(k).orderBy(F.desc("n"), "t").limit(max_terms).collect()]
    if not chosen:
        return QualityModel({}, np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), 0.5)
    ids = {t: i for i, (t, _) in enumerate(chosen)}

    def rows_of(batches):
        terms = Terms(ids)
        for batch in batches:
            y, at = batch.column("y"), 0
            for x in term_rows(batch.column("text"), terms):
                yield pa.RecordBatch.from_arrays([y.slice(at, len(x)), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["y", "x"])
                at += len(x)

    rows = sorted((r["y"], bytes(r["x"])) for r in own.mapInArrow(rows_of, "y int, x binary").collect())
    x, y = np.array([np.frombuffer(r, "<f4") for _, r in rows], float), np.array([y for y, _ in rows], float)
    model = QualityModel(ids, np.array([np.log(1 + len(rows) / n) for _, n in chosen]), np.eye(len(chosen)), np.zeros((0, 0)), y, float(y.mean()), neighbours)
    weighted = np.sqrt(x) * model.idf
    values, axes = np.linalg.eigh(weighted.T @ weighted)
    model.axes = axes[:, ::-1][:, :rank]
    model.vectors = model.project(x)
    return model


def scorer(model: QualityModel, spark):
    """A column function of a text column."""
    shared, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        terms = held(("quality", name), lambda: Terms(shared.value.vocabulary))
        out = [shared.value.score(x) for x in term_rows(texts, terms)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    score = scorer(fit(docs, labels, **kw), docs.sparkSession)
    rows = documents(docs).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns."""
    score = scorer(fit(docs, labels, **kw), docs.sparkSession)
    return docs.where(score(F.coalesce(F.col("text"), F.lit(""))) >= threshold)

