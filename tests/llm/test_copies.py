import hashlib
import itertools
import re

import duckdb
import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from pyspark.sql import functions as F

from motrac.llm import common, components, dedup, rangejoin, simhash
from motrac.llm.common import scratch_path


def _groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (500, 2))] + [(k, k + 1) for k in range(1000, 1300)] + [(5000, k) for k in range(2000, 2400)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect()}
    want = _groups({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _expected_copies(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    by = {}
    for (i, _), n in zip(rows, norm):
        by.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        known = [x for x in by[n] if x is not None]
        out.append((i or -1, min(known, default=-1), len(by[n]), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out), len(by)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates(docs, no_docs, texts, weak):
    digest = (lambda b: bytes([hashlib.sha256(b).digest()[0] % 3])) if weak else dedup.sha256
    got = dedup.exact_duplicates(docs, digest=digest, memtable_rows=4).collect()
    want, n_groups = _expected_copies(texts)
    assert sum(r["kept"] for r in got) == n_groups
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"]) for r in got) == [w[:3] for w in want]
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    if not weak:
        assert sorted((r["doc_id"] or -1, r["text_sha256"]) for r in got) == sorted((w[0], w[3]) for w in want)
    assert dedup.exact_duplicates(no_docs).count() == 0


def test_exact_duplicates_hot_group(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k // 2}") for k in range(3000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), memtable_rows=50).collect()}
    want, _ = _expected_copies([(k + 1, t) for k, t in rows])
    assert {k: v[:2] for k, v in got.items()} == {w[0] - 1: (w[1] - 1, w[2]) for w in want}
    assert sum(v[2] for v in got.values()) == len({t for _, t in rows})


def test_shards_spill_runs_to_the_shared_folder(spark, monkeypatch):
    """Memtables of 20 digests and one shard: every run but the last is a file, and none is left behind."""
    made = []
    monkeypatch.setattr(dedup, "scratch_path", lambda spark, tag: made.append(scratch_path(spark, tag)) or made[-1])
    rows = [(k, "same text" if k % 3 == 0 else f"text {k // 2}") for k in range(1500)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), memtable_rows=50, memtable=20).collect()}
    want, _ = _expected_copies([(k + 1, t) for k, t in rows])
    assert got == {w[0] - 1: (w[1] - 1, w[2]) for w in want}
    fs, base = pafs.FileSystem.from_uri(made[0])
    assert fs.get_file_info(base).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(base))


def test_merge_index(tmp_path):
    rng = np.random.default_rng(4)
    index, want = dedup.MergeIndex(f"file://{tmp_path}", memtable=16, fan_in=3), {}
    for k, d in enumerate(rng.integers(0, 200, 2000).tolist()):
        key = dedup.sha256(bytes([d]))
        index.put(key, (2000 - k, k, 1, 1))
        old = want.get(key, (9999, 0, 0, 0))
        want[key] = (2000 - k, k, old[2] + 1, old[3] + 1)
    assert all(index.get(k) == v for k, v in want.items()) and index.get(b"x" * 32) is None
    assert dict(index.items()) == want and 1 <= len(list(tmp_path.iterdir())) < 3
    index.close()
    assert not list(tmp_path.iterdir())


def test_spread_join(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(600)] + [(None, -1), (500, -2)], "key long, x long")
    keyed = rows.where("key <> 500").groupBy("key").count().withColumn("y", -F.col("key"))
    pairs = lambda how: sorted(tuple(r) for r in common.spread_join(rows, keyed, "key", "count", how=how).select("x", "key").collect())
    known = sorted((r["x"], r["key"]) for r in rows.where("key <> 500").collect())
    assert pairs("inner") == known and [p[0] for p in pairs("left_anti")] == [-2, -1]
    assert len(pairs("left")) == 602


def _fingerprint(text):
    low = "".join([c.lower() if c.isascii() else c for c in text or ""])
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_operator(docs, no_docs, texts, spark, sf_dir):
    big = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for table, rows in ((docs, texts), (big, [(r["doc_id"], r["text"]) for r in big.collect()])):
        got = simhash.near_duplicates(table).collect()
        fps = [_fingerprint(t) for _, t in rows]
        near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin(fps[i] ^ fps[j]).count("1") <= 4]
        group = _groups(range(len(rows)), near)
        least = {}
        for k, g in group.items():
            if rows[k][0] is not None:
                least[g] = min(least.get(g, 1 << 62), rows[k][0])
        want = sorted((rows[k][0] if rows[k][0] is not None else -1, f"{fps[k]:016x}", least.get(group[k], -1)) for k in range(len(rows)))
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"] if r["component_id"] is not None else -1) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_keys_are_divided(spark):
    """A chain of fingerprints that one key files together, and others, in blocks of three."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(8)} | {int(x) for x in rng.integers(0, 2**62, 200)}
    near = [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin(a ^ b).count("1") <= 4]
    want = {n: r for n, r in _groups(fps, near).items() if n != r}
    for block in (3, 8192):
        made = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
        assert {r["node"]: r["root"] for r in components.components(made).collect()} == want


def test_simhash_of_long_texts_in_windows():
    text = " ".join(f"w{k % 977}x{k // 7}" for k in range(300_000))
    assert len(text) > 2 << 20 and simhash.fingerprint(text.encode()) == _fingerprint(text)


@pytest.mark.parametrize("n", [400, 10**7, 10**10])
def test_pigeonhole_plans_lose_no_pair(n):
    """Whatever the plan for n fingerprints, pairs within the threshold share a mask's bits."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)
    bits = np.unpackbits(base.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    gram = np.rint(bits.T @ bits * (n / 400)).astype(np.int64)
    keep = [m & (1 << 64) - 1 for m in simhash.masks(simhash.plan(n, gram))]
    assert len(keep) == len(set(keep))
    for _ in range(3000):
        x, flips = int(base[rng.integers(400)]), rng.choice(64, rng.integers(0, 5), replace=False)
        y = x
        for b in flips:
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in keep)


def test_simhash_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    near = [int(b) for b in base]
    for b in base[:60].tolist():
        for _ in range(20):
            y = b
            for k in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(k)
            near.append(y)
    near += [base[0].item() ^ (1 << int(a)) ^ (1 << int(b)) for a in range(40) for b in range(a)]
    fps = np.unique(np.array(near, np.uint64))
    dist = np.bitwise_count(fps[:, None] ^ fps[None, :])
    want = _groups(fps.view(np.int64).tolist(), [(fps.view(np.int64)[i].item(), fps.view(np.int64)[j].item()) for i, j in np.argwhere(np.triu(dist <= 4, 1))])
    links = simhash.links(spark.createDataFrame([(x,) for x in fps.view(np.int64).tolist()], "fp long").repartition(5))
    got = _groups(want, [(r["a"], r["b"]) for r in links.collect()])
    assert {n: sorted(k for k in got if got[k] == got[n])[0] for n in got} == {n: sorted(k for k in want if want[k] == want[n])[0] for n in want}


def _vectors_expected(rows, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    scaled = [np.array(v, float) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok)]
    unit = [v / np.linalg.norm(v) if o else None for v, o in zip(scaled, ok)]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    group = _groups(range(len(rows)), near)
    n = np.bincount([k for p in near for k in p], minlength=len(rows))
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, 1 << 62), rows[k][0])
    return sorted((rows[k][0], int(n[k]), least[group[k]], least[group[k]] == rows[k][0]) for k in range(len(rows)))


def test_range_join(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)]
    rows += [(300 + k, (np.array(rows[k % 7][1]) + 0.15 * rng.normal(size=6)).tolist()) for k in range(150)]
    rows += [(500 + k, rows[3][1]) for k in range(40)] + [(600, (2.5 * np.array(rows[3][1])).tolist()), (601, (1e-200 * np.array(rows[3][1])).tolist())]
    rows += [(700, None), (701, []), (702, [0.0] * 6), (703, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (704, [float("nan")] * 6), (705, [float("inf")] + [1.0] * 5), (706, [1.0, 2.0]), (707, [1.0, 2.0]), (708, [-0.0, 1.0]), (709, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = _vectors_expected(rows)
    for block in (8192, 32):
        monkeypatch.setattr(rangejoin, "BLOCK", block)
        got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rangejoin.near_vectors(table).collect())
        assert got == want
    assert rangejoin.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op9_exact_dedup"])
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    from motrac.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetch_df()
    got = queries.queries()[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))
