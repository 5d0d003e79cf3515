"""Connected components of a link table, by alternating stars, without collecting links.

A large star hangs each node's larger neighbours on the smallest one it knows; a
small star does so with the smaller ones. Both keep components as they are, and
their alternation ends in stars around the smallest node. Each round is written
to the shared folder. Minima are aggregated before the shuffle, and the few nodes
with very many links get their minimum by broadcast, so that no star's centre
gathers its links in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import materialize, spread_join

MAX_ROUNDS = 60


def min_labels(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index of a symmetric boolean matrix reaches, itself included."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def union(pairs_a: np.ndarray, pairs_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node of its component) with the components of the given links."""
    nodes, codes = np.unique(np.concatenate([pairs_a, pairs_b]), return_inverse=True)
    a, b = codes[: len(pairs_a)], codes[len(pairs_a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _contract(batches):
    """Links of one partition to a forest, a block of links at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def forest():
        return union(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size > 2_000_000:
            f = forest()
            if len(f[0]) > size // 2:
                yield pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], names=["u", "v"])
                held, size = [], 0
            else:
                held, size = [f], len(f[0])
    if held:
        f = forest()
        yield pa.RecordBatch.from_arrays([pa.array(f[0]), pa.array(f[1])], names=["u", "v"])


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return r[0], r[1]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a smaller one in its component; root is the smallest.

    Nodes that are absent stand for themselves. Links of a node with itself and nulls are ignored.
    """
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v")
    edges = materialize(links.mapInArrow(_contract, "u long, v long").distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        mark = _mark(edges)
        if mark == before or not mark[0]:
            break
        before = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "least")
        large = spread_join(both.where("v > u"), least, "u", "n", 2 * mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # A node has at most one row here for each smallest node that its links know, so none is hot.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
