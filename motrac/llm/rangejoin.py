"""Exact near-duplicates among vectors: a metric range join over pivot cells.

Vectors of unit length within a cosine are within a chord of each other. Each
distinct vector belongs to the cell of its nearest pivot. By the triangle
inequality a vector can only be within the chord eps of some vector of another
cell if it is at most 2 eps farther from that cell's pivot than from its own, and
at most eps outside that cell's radius; there it is replicated. Of two cells it
is the smaller number that gets the other's vectors if their sum is even, else
the larger, so each pair meets once and no cell gets all visitors. Cells join
independently.
A large cell is divided in blocks, and its vectors go to each later block: beyond
the most pivots there are more blocks a cell, never fewer comparisons.

Vectors are screened in single precision with a margin that covers its error and
then compared in double precision. Equal vectors are one with a weight, so copies
are counted and never paired. Links leave a cell as counts and star links only.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components are rows without links; vectors of different lengths never link;
repeated rows count as other vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import materialize, spread_join
from motrac.llm.components import components, union

#: Own vectors that one block of a cell holds, and the most pivots.
BLOCK = 8192
MAX_PIVOTS = 4096


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; a large or small scale is taken out first so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _rows(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def _deal(pivots: np.ndarray, radius: np.ndarray | None, blocks: dict[int, int], eps: float):
    """Each vector to its own block (role 0) and to where it may have partners (role 1)."""
    slack = 1e-9
    squares = (pivots * pivots).sum(1)

    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in ("rep", "weight", "v")]
            unit = _unit(_rows(cols[2]))
            for i in range(0, len(unit), 4096):
                x = unit[i : i + 4096]
                d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + squares[None, :] - 2 * x @ pivots.T, 0))
                own = d.argmin(1)
                near = d[np.arange(len(x)), own]
                if radius is None:
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(near)], names=["cell", "d"])
                    continue
                may = (d <= near[:, None] + 2 * eps + slack) & (d <= radius[None, :] + eps + slack)
                cells = np.arange(len(pivots))[None, :]
                may &= (cells != own[:, None]) & ((cells < own[:, None]) == ((cells + own[:, None]) % 2 == 0))
                rep = cols[0].slice(i, len(x)).to_numpy()
                salt = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                who, cell, block, role = [], [], [], []
                n_blocks = np.array([blocks.get(int(c), 1) for c in own])
                mine = (salt % n_blocks.astype(np.uint64)).astype(np.int64)
                who.append(np.arange(len(x))), cell.append(own), block.append(mine), role.append(np.zeros(len(x), int))
                for c in np.unique(own[n_blocks > 1]):
                    at = np.flatnonzero(own == c)
                    for b in range(1, blocks[int(c)]):
                        later = at[mine[at] < b]
                        who.append(later), cell.append(np.full(len(later), c)), block.append(np.full(len(later), b)), role.append(np.ones(len(later), int))
                for c in np.flatnonzero(may.any(0)):
                    at = np.flatnonzero(may[:, c])
                    for b in range(blocks.get(int(c), 1)):
                        who.append(at), cell.append(np.full(len(at), c)), block.append(np.full(len(at), b)), role.append(np.ones(len(at), int))
                who = np.concatenate(who)
                for j in range(0, len(who), 8192):
                    k = slice(j, j + 8192)
                    take = pa.array(who[k] + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(cell)[k], pa.int32()), pa.array(np.concatenate(block)[k], pa.int32()), pa.array(np.concatenate(role)[k], pa.int32()), *[c.take(take) for c in cols]],
                        names=["cell", "block", "role", "rep", "weight", "v"],
                    )

    return run


def _join(threshold: float):
    """Over rows sorted by (cell, block, role): own vectors against themselves and the visitors that stream by."""

    def compare(x: dict, y: dict):
        margin = 1e-5 + 1e-6 * x["unit"].shape[1]
        i, j = np.nonzero(x["f32"] @ y["f32"].T >= threshold - margin)
        ok = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            ok[k : k + (1 << 15)] = np.einsum("ij,ij->i", x["unit"][p], y["unit"][q]) >= threshold
        return i[ok], j[ok]

    def side(rep, weight, rows):
        unit = _unit(rows)
        return {"rep": rep, "weight": weight, "unit": unit, "f32": unit.astype(np.float32)}

    def solve(x: dict, y: dict, same: bool):
        """Counts for each vector and star links, from blocks of pairs that never leave here."""
        for a in range(0, len(x["rep"]), 512):
            part = {k: v[a : a + 512] for k, v in x.items()}
            i, j = compare(part, y)
            if same:
                up = i + a < j
                i, j = i[up], j[up]
            if not len(i):
                continue
            n = np.concatenate([np.bincount(i, weights=y["weight"][j], minlength=len(part["rep"])), np.bincount(j, weights=part["weight"][i], minlength=len(y["rep"]))]).astype(np.int64)
            rep = np.concatenate([part["rep"], y["rep"]])
            yield pa.RecordBatch.from_arrays([pa.array(rep[n > 0]), pa.array(n[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64())], names=["rep", "n", "root"])
            u, v = union(part["rep"][i], y["rep"][j])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.zeros(len(u), np.int64)), pa.array(v)], names=["rep", "n", "root"])

    def run(batches):
        key, own, parts = None, None, []
        for batch in batches:
            cells, blocks, roles = (batch.column(c).to_numpy() for c in ("cell", "block", "role"))
            ids = np.stack([cells, blocks, roles], 1)
            cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(1)]))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                here = (int(cells[a]), int(blocks[a]))
                rows = side(batch.column("rep").slice(a, b - a).to_numpy(), batch.column("weight").slice(a, b - a).to_numpy(), _rows(batch.column("v").slice(a, b - a)))
                if here != key:
                    if parts:
                        own = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                        yield from solve(own, own, True)
                    key, own, parts = here, None, []
                if roles[a] == 0:
                    parts.append(rows)
                    continue
                if own is None:
                    own = {k: np.concatenate([p[k] for p in parts]) for k in rows} if parts else {}
                    if own:
                        yield from solve(own, own, True)
                    parts = []
                if own:
                    yield from solve(own, rows, False)
        if parts:
            own = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            yield from solve(own, own, True)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    finite = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)))
    rows = materialize(rows, "vectors")
    distinct = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep_id"), F.first("v").alias("v"), F.count("*").alias("weight"))
    distinct = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct")
    sizes = [(r["d"], r["n"]) for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]

    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    found: list[DataFrame] = []
    for dim, n in sizes:
        own = distinct.where(F.size("v") == dim)
        k = int(min(MAX_PIVOTS, max(1, n // (BLOCK // 2))))
        chosen = own.orderBy(F.xxhash64("key"), "rep").limit(k).select("v").collect()
        pivots = _unit(np.array([r["v"] for r in chosen], np.float64))
        known = own.mapInArrow(_deal(pivots, None, {}, eps), "cell int, d double").groupBy("cell").agg(F.max("d").alias("r"), F.count("*").alias("n")).collect()
        radius = np.full(len(pivots), -np.inf)
        blocks = {}
        for r in known:
            radius[r["cell"]] = r["r"]
            if r["n"] > BLOCK:
                blocks[r["cell"]] = -(-r["n"] // BLOCK)
        dealt = own.mapInArrow(_deal(pivots, radius, blocks, eps), "cell int, block int, role int, rep long, weight long, v array<double>")
        tasks = max(1, len(pivots) + sum(b - 1 for b in blocks.values()))
        found.append(dealt.repartition(tasks, "cell", "block").sortWithinPartitions("cell", "block", "role").mapInArrow(_join(threshold), "rep long, n long, root long"))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    links = materialize(links, "vector-links")
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(links.where("root is not null").select("rep", "root"), "rep", "root")
    named = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("key", "rep", "rep_id", "weight", F.coalesce("root", "rep").alias("root"))
    named = materialize(named.join(counts, "rep", "left"), "vector-roots")
    least = materialize(named.groupBy("root").agg(F.min("rep_id").alias("component_id"), F.count("*").alias("vectors")), "vector-least")
    classes = spread_join(named, least, "root", "vectors").select("key", "weight", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = spread_join(rows.where("key is not null").select("vec_id", "key"), materialize(classes, "vector-classes"), "key", "weight").select("vec_id", "n_links", "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = out.unionByName(alone)
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
