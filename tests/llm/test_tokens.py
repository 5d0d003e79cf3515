import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motrac.llm import packing, planes, tokens, trie

CHARS = "aabeinthsou'ls .,!_0éß²Σ漢\u0301|<>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


@pytest.fixture(scope="module")
def samples(texts):
    rng = random.Random(3)
    made = ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    return [t or "" for _, t in texts] + made + ["a<|endoftext|>b <|startoftext|>", "it's'll don't''s", "_a__b_ x_y"]


def test_chunk_encoder_equals_library(library, samples):
    enc = tokens.ChunkEncoder(tokens.default_path(), max_entries=500)
    for s in samples:
        assert enc.encode(s) == library.encode(s, add_special_tokens=False).ids, s[:60]


def test_trie_equals_library(library, samples):
    enc = trie.TrieEncoder(tokens.default_path(), max_entries=500)
    for s in samples:
        ids = library.encode(s, add_special_tokens=False).ids
        assert enc.encode(s) == ids, s[:60]
        assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_trie_operator(docs, no_docs, library, texts):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in trie.encode_decode(docs).collect())
    want = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((i or -1, len(ids), *sha))
    assert got == sorted(want)
    assert trie.encode_decode(no_docs).count() == 0


def _ids(library, t):
    return np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")


def test_planes_operator(docs, no_docs, library, texts, tmp_path):
    for bits, block in ((False, 1 << 16), (True, 1000)):
        got = planes.plane_round_trip(docs, f"file://{tmp_path}/{bits}", bits=bits, block=block).collect()
        assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((i or -1, len(_ids(library, t)), zlib.crc32(_ids(library, t).tobytes())) for i, t in texts)
        rows = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
        known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert known == sorted(known)
    assert planes.plane_round_trip(no_docs).count() == 0


def test_planes_leave_other_files_alone_and_divide_rows_of_one_id(spark, docs, texts, tmp_path):
    other = tmp_path / "tokens-of-another-run.tpl"
    other.write_bytes(b"x")
    same = docs.withColumn("doc_id", F.lit(None).cast("long")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = planes.write_planes(same, f"file://{tmp_path}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert other.exists() and len(list(tmp_path.glob("*.tpl"))) == 1 + index.count() and index.count() > 1
    assert planes.read_planes(index).count() == len(texts)


@pytest.mark.parametrize("bits", [False, True])
def test_plane_file_random_access(bits):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 2**32, 2500, dtype=np.uint32)
    sink = io.BytesIO()
    out = planes.PlaneWriter(sink, block=256, bits=bits)
    sizes = np.array([0, 1000, 1, 1499])
    out.add(np.array([5, 6, 7, 8]), np.array([1, 1, 0, 1]), sizes, ids)
    out.close()
    data = sink.getvalue()
    r = planes.PlaneReader(io.BytesIO(data), len(data))
    assert (r.ids(0, 2500) == ids).all() and (r.ids(300, 301) == ids[300:301]).all() and (r.ids(250, 1030) == ids[250:1030]).all() and len(r.ids(7, 7)) == 0
    assert r.known.tolist() == [True, True, False, True] and r.sizes.tolist() == sizes.tolist()


def _check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing_operator(docs, no_docs, library, texts):
    got = packing.best_fit_packing(docs, capacity=4096).collect()
    n = _check_packing(got, 4096)
    want = sorted((i or -1, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for i, t in texts for ids in [_ids(library, t)] for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096))))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert n == -(-sum(w[3] for w in want) // 4096)
    assert packing.best_fit_packing(no_docs).count() == 0


def test_packing_exchange_beats_one_round(spark):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 3000).tolist()
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long").repartition(5)
    got = packing.pack(items, capacity=100, partition_pieces=300).collect()
    assert sorted((r["k"], r["length"]) for r in got) == list(enumerate(lengths))
    n, bound = _check_packing(got, 100), packing.global_bound(items, 100)
    whole = packing.best_fit_decreasing(np.array(lengths), 100)[0].max() + 1
    alone = sum(packing.best_fit_decreasing(np.array(lengths[i::10]), 100)[0].max() + 1 for i in range(10))
    assert bound <= n <= whole * 1.01 and n < alone
    assert packing.certificate(spark.createDataFrame([(r["length"], r["offset"]) for r in got], "length long, offset long"), 100) == (n, bound)


def test_packing_exchanges_until_nothing_is_saved(spark):
    """Pieces over half a sequence, and others of which just one fits beside each: dealt at random, most partitions have too many of one kind."""
    lengths = [60] * 400 + [40] * 400
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long").repartition(4)
    got = packing.pack(items, capacity=100, partition_pieces=50, most_pieces=100).collect()
    n = _check_packing(got, 100)
    assert sorted(r["k"] for r in got) == list(range(800))
    assert n == 400 == packing.global_bound(items, 100)
    whole = packing.pack(items, capacity=100).collect()
    assert _check_packing(whole, 100) == 400 and all(r["certified"] for r in whole)


def _fits(sizes, capacity, n):
    """Whether sizes fit n bins, by search."""
    def go(i, room):
        if i == len(sizes):
            return True
        for r in {r for r in room if r >= sizes[i]}:
            k = room.index(r)
            if go(i + 1, [*room[:k], r - sizes[i], *room[k + 1 :]]):
                return True
        return False

    return go(0, [capacity] * n)


def test_lower_bound_never_over_the_best():
    rng = random.Random(2)
    for _ in range(150):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        best = next(n for n in range(1, 10) if _fits(sizes, 20, n))
        bound = packing.lower_bound(np.bincount(sizes, minlength=21), 20)
        bins, offsets = packing.best_fit_decreasing(np.array(sizes), 20)
        assert bound <= best <= bins.max() + 1
    assert packing.lower_bound(np.bincount([11] * 7, minlength=21), 20) == 7
