"""SimHash fingerprints linked by the generalised pigeonhole principle.

Bits that go together are grouped into partitions. A pair within tau bits has,
for thresholds that sum to tau - m + 1 over m partitions, a partition within its
own threshold; a threshold of -1 leaves a partition out. The number of partitions
and the thresholds are the cheapest by dynamic programming over estimated
costs: the keys that each threshold makes, and the candidates that bits as
frequent as those of all fingerprints would bring together. A fingerprint is
filed under its partition's bits with each choice of t of them left out, so two
that differ there in t bits at most meet. Where they meet, all bits are compared.

Fingerprints are linked as distinct values. Within a key no pair is written out:
each component of what is linked there gives a star. A key under which more than
BLOCK values are filed is divided in blocks of them, and each two blocks meet in a
cell of their own, so that no task holds or compares more than two blocks.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; under four words the whole sequence is the one shingle; repeated rows
share their component; a null doc_id never becomes a component_id unless it has
no other; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import documents, materialize, spread_join, windows
from motrac.llm.components import components, min_labels, union

BITS = 64
#: Cost of one filed key and of one compared pair, in about microseconds.
KEY_COST, PAIR_COST = 2.0, 0.02
#: Values of one key that a task compares at once; longer keys are divided.
BLOCK = 8192
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


class _Votes:
    """Counts of set bits over many hashes."""

    def __init__(self):
        self.ones, self.n = np.zeros(BITS, np.int64), 0

    def add(self, hashes: list[int]) -> None:
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            self.ones[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _TABLE
        self.n += len(hashes)

    def value(self) -> int:
        return sum(1 << k for k in range(BITS) if 2 * self.ones[k] > self.n)


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the XXH64 of the text's shingles of size words."""
    import xxhash

    digest, votes, tail = xxhash.xxh64_intdigest, _Votes(), []
    for part in windows(text):
        words = tail + part.lower().split()
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            votes.add([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())])
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
    if not votes.n:
        return digest(b" ".join(tail), seed) if tail else 0
    return votes.value()


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), size, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def fingerprint_of(text: Column, size: int = 4, seed: int = 42) -> Column:
    """The fingerprint of a text column, as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_buffer().to_pybytes(), size, seed) for t in texts], np.uint64).view(np.int64))

    return run(F.coalesce(text.cast("string"), F.lit("")))


def _gram(batches):
    total, n = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for i in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(fps[i : i + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
            n += len(bits)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array([*i, BITS], pa.int32()), pa.array([*j, BITS], pa.int32()), pa.array([*total[i, j], n], pa.int64())], names=["i", "j", "n"])


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and, of all of them, how many have bits i and j: 2081 rows whatever the input."""
    gram, n = np.zeros((BITS, BITS), np.int64), 0
    for r in fps.mapInArrow(_gram, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] == BITS:
            n = r["n"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["n"]
    return n, gram


def group_bits(n: int, gram: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each starts with the bit most correlated with those left and takes the ones closest to it."""
    p = np.diag(gram) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    rho = np.abs(gram / max(1, n) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(rho, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        sub = rho[np.ix_(left, left)]
        group = [left.pop(int(sub.sum(1).argmax()))]
        while len(group) < width:
            group.append(left.pop(int(rho[np.ix_(left, group)].mean(1).argmax())))
        groups.append(sorted(group))
    return groups


def plan(n: int, gram: np.ndarray, tau: int = 4, most: int = 6) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, the cheapest found for m = 1..most partitions."""
    p = np.diag(gram) / max(1, n)
    same = p * p + (1 - p) * (1 - p)
    best: tuple[float, list] = (math.inf, [])
    for m in range(2, most + 1):
        groups = group_bits(n, gram, m)
        table = {(0, 0): (0.0, [])}
        for k, g in enumerate(groups):
            meet = np.zeros(tau + 2)
            meet[0] = 1
            for b in g:
                meet[1:], meet[0] = meet[1:] * same[b] + meet[:-1], meet[0] * same[b]
            cost = [0.0] + [KEY_COST * n * math.comb(len(g), t) + PAIR_COST * n * n / 2 * meet[t] if math.comb(len(g), t) <= 800 else math.inf for t in range(tau + 1)]
            for used in range(tau + 2):
                if (k, used) in table:
                    so_far, chosen = table[k, used]
                    for t in range(-1, tau + 1 - used):
                        key, c = (k + 1, used + t + 1), so_far + cost[t + 1]
                        if c < table.get(key, (math.inf,))[0]:
                            table[key] = (c, [*chosen, t])
        total, chosen = table.get((m, tau + 1), (math.inf, []))
        if total < best[0]:
            best = (total, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """For each partition and each choice of t of its bits to leave out, the bits that stay; all masks differ."""
    out = []
    for group, t in parts:
        whole = sum(1 << b for b in group)
        out += [whole & ~sum(1 << b for b in drop) for drop in combinations(group, t)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def _near(a: np.ndarray, b: np.ndarray, tau: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= tau


def _links_within(fps: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the components of the given distinct fingerprints; visits each once, comparing it with what no one has reached yet."""
    if len(fps) <= 512:
        near = _near(fps, fps, tau)
        if near.sum() == len(fps):
            return fps[:0], fps[:0]
        label = min_labels(near)
        keep = label != np.arange(len(fps))
        return fps[keep], fps[label[keep]]
    left, out_a, out_b = fps, [], []
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            take, front = front[:256], front[256:]
            hit = np.zeros(len(left), bool)
            for i in range(0, len(left), 1 << 14):
                hit[i : i + (1 << 14)] = _near(take, left[i : i + (1 << 14)], tau).any(axis=0)
            if hit.any():
                front = np.concatenate([front, left[hit]])
                out_a.append(left[hit])
                out_b.append(np.full(int(hit.sum()), seed))
                left = left[~hit]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (fps[:0], fps[:0])


def _probe(tau: int):
    """Over rows sorted by key: the links of each key's fingerprints."""

    def solve(keys: np.ndarray, fps: np.ndarray):
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(cut, len(keys)))
        a, b = [], []
        for s in (2, 3, 4):
            at = cut[size == s]
            if len(at):
                rows = fps[at[:, None] + np.arange(s)]
                for i in range(s):
                    for j in range(i + 1, s):
                        ok = np.bitwise_count(rows[:, i] ^ rows[:, j]) <= tau
                        a.append(rows[ok, j])
                        b.append(rows[ok, i])
        for at, s in zip(cut[size > 4].tolist(), size[size > 4].tolist()):
            x, y = _links_within(np.unique(fps[at : at + s]), tau)
            if len(x):
                a.append(x)
                b.append(y)
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            ok = x != y
            x, y = union(x[ok], y[ok]) if ok.any() else (x[ok], y[ok])
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if rows + len(keys) < 200_000 or (last == 0 and held and held[-1][0][-1] == keys[0]):
                held.append((keys, fps))
                rows += len(keys)
                continue
            whole = [*held, (keys[:last], fps[:last])]
            yield from solve(np.concatenate([h[0] for h in whole]), np.concatenate([h[1] for h in whole]))
            held, rows = [(keys[last:], fps[last:])], len(keys) - last
        if rows:
            yield from solve(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return run


def _cells(filed: DataFrame, block: int) -> DataFrame:
    """(key, fp) rows with keys of over block values divided: every two values of a key still meet under one key."""
    heavy = materialize(filed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "heavy-keys")
    if not heavy.head(1):
        return filed
    n = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64(F.lit(11), "fp"), n)
    met = spread_join(filed, heavy, "key", "n").select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    met = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    return spread_join(filed, heavy, "key", "n", how="left_anti").unionByName(met)


def links(fps: DataFrame, tau: int = 4, block: int = BLOCK) -> DataFrame:
    """Star links (a, b) with the components of distinct fingerprints at most tau bits apart."""
    n, gram = bit_counts(fps)
    keep = masks(plan(n, gram, tau))
    filed = fps.select("fp", F.explode(F.array(*map(F.lit, keep))).alias("mask")) if keep else fps.select("fp", F.lit(0).cast("long").alias("mask"))
    filed = filed.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    return _cells(filed, block).repartition("key").sortWithinPartitions("key").mapInArrow(_probe(tau), "a long, b long")


def labelled(docs: DataFrame, tau: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, fp, root (the least fingerprint of the component, which names it), component_id."""
    rows = materialize(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    values = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "values")
    roots = components(links(values.select("fp"), tau, block))
    named = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("values")), "least")
    by_value = materialize(spread_join(named, least, "root", "values").select("fp", "n", "root", "component_id"), "classes")
    return spread_join(rows, by_value, "fp", "n").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, tau: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return labelled(docs, tau, size, seed, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
