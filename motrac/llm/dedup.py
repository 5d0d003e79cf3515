"""Exact duplicates by a log-structured merge index of digests.

Tasks that read texts gather digests in memtables and flush them as runs sorted
by digest, a row for each digest of a run with all its identifiers; a digest
that a third of all rows share so reaches the shuffle once a run. Runs are dealt
by digest to shards, as many as rows ask for. A shard is a log-structured merge
index: a memtable that is flushed to sorted runs with Bloom filters in the shared
folder, looked up through the filters, and compacted so that the smallest
identifier stays. Digests that more than one row
has are hits, and their texts are compared byte by byte in a second pass that a
filter of all hits keeps from moving other texts. Should two texts share a
digest, the rows of that digest are grouped by their texts.

Equal means identical after each run of ASCII white space is one space.

Edge cases: null counts as empty; of repeated rows with the smallest doc_id one
is kept; rows with a null doc_id are kept only where their group has no other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
import uuid
from collections.abc import Callable
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import documents, materialize, scratch_path, spread_join

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
RUN_SCHEMA = "digest binary, ids array<long>, min_id long, entry long"
#: Digests that a shard's memtable holds before it becomes a run, and entries that one shard indexes.
MEMTABLE, SHARD_ROWS = 100_000, 4_000_000
INDEX_SCHEMA = "digest binary, keep_id long, keep_entry long, group_size long, n_entries long"
NONE = (1 << 63) - 1


def normalise(text: bytes) -> bytes:
    return SPACES.sub(b" ", text)


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


class Bloom:
    """A Bloom filter over digests, whose own bytes serve as hashes."""

    def __init__(self, n: int, bits_per_key: int = 12, max_bits: int = 1 << 29):
        self.n_bits = max(1024, min(max_bits, n * bits_per_key))
        self.bits = bytearray(self.n_bits // 8 + 1)

    def _places(self, digest: bytes):
        h = hashlib.blake2b(digest, digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
        return [(a + k * b) % self.n_bits for k in range(6)]

    def add(self, digest: bytes) -> None:
        for p in self._places(digest):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, digest: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(digest))


class Run:
    """A sorted run in a file of the shared folder: blocks of rows, the first digest of each, and a filter in memory."""

    KINDS = [pa.binary(), *[pa.int64()] * 4]
    SCHEMA = pa.schema(list(zip(["digest", "keep_id", "keep_entry", "group_size", "n_entries"], KINDS)))

    def __init__(self, folder: str, items, n: int, block: int = 4096):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path, self.bloom, self.firsts, self.rows = f"{base}/{uuid.uuid4().hex}.run", Bloom(n), [], 0
        with self.fs.open_output_stream(self.path) as sink, pa.ipc.new_file(sink, self.SCHEMA) as out:
            for part in batched(items, block):
                self.firsts.append(part[0][0])
                self.rows += len(part)
                for k, _ in part:
                    self.bloom.add(k)
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(k, *v) for k, v in part]), self.KINDS)], schema=self.SCHEMA))

    def _block(self, f, k: int) -> list[tuple]:
        batch = pa.ipc.open_file(f).get_batch(k)
        return list(zip(*[c.to_pylist() for c in batch.columns]))

    def get(self, digest: bytes) -> tuple | None:
        if not self.firsts or digest not in self.bloom:
            return None
        with self.fs.open_input_file(self.path) as f:
            rows = self._block(f, max(0, bisect.bisect_right(self.firsts, digest) - 1))
        i = bisect.bisect_left(rows, digest, key=lambda r: r[0])
        return rows[i][1:] if i < len(rows) and rows[i][0] == digest else None

    def items(self):
        """All rows in order, one block in memory."""
        with self.fs.open_input_file(self.path) as f:
            for k in range(len(self.firsts)):
                for r in self._block(f, k):
                    yield r[0], r[1:]

    def drop(self) -> None:
        self.fs.delete_file(self.path)


class MergeIndex:
    """digest -> (smallest id, its entry, rows, entries): a memtable over sorted runs with filters.

    Memory holds the memtable, a block of each run and the filters; runs are files of the given folder.
    """

    def __init__(self, folder: str, memtable: int = MEMTABLE, fan_in: int = 8):
        self.memtable: dict[bytes, tuple] = {}
        self.runs: list[Run] = []
        self.folder, self.limit, self.fan_in = folder, memtable, fan_in

    @staticmethod
    def merge(x: tuple, y: tuple) -> tuple:
        return (*min(x[:2], y[:2]), x[2] + y[2], x[3] + y[3])

    def put(self, digest: bytes, value: tuple) -> None:
        old = self.memtable.get(digest)
        self.memtable[digest] = value if old is None else self.merge(old, value)
        if len(self.memtable) >= self.limit:
            self.flush()

    def get(self, digest: bytes) -> tuple | None:
        found = self.memtable.get(digest)
        for run in self.runs:
            own = run.get(digest)
            if own is not None:
                found = own if found is None else self.merge(found, own)
        return found

    def flush(self) -> None:
        if self.memtable:
            self.runs.append(Run(self.folder, sorted(self.memtable.items()), len(self.memtable)))
            self.memtable = {}
        if len(self.runs) >= self.fan_in:
            self.compact()

    def _merged(self, *more):
        """All runs in one order; of equal digests the smallest identifier stays."""
        last = None
        for k, v in heapq.merge(*[r.items() for r in self.runs], *more, key=lambda x: x[0]):
            if last and last[0] == k:
                last = (k, self.merge(last[1], v))
                continue
            if last:
                yield last
            last = (k, v)
        if last:
            yield last

    def compact(self) -> None:
        """All runs in one file; the old ones go."""
        new = Run(self.folder, self._merged(), sum(r.rows for r in self.runs))
        for r in self.runs:
            r.drop()
        self.runs = [new]

    def items(self):
        """All digests in order; what the memtable holds is merged from memory."""
        yield from self._merged(sorted(self.memtable.items()))

    def close(self) -> None:
        for r in self.runs:
            r.drop()
        self.runs, self.memtable = [], {}


def _runs(digest: Callable[[bytes], bytes], memtable_rows: int):
    def run(batches):
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 40, 0
        table: dict[bytes, list] = {}
        held = 0

        def flushed():
            nonlocal made
            items = sorted(table.items())
            mins = [min((i for i in ids if i is not None), default=None) for _, ids in items]
            entries = np.arange(made, made + len(items)) + base
            made += len(items)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.binary()), pa.array([v for _, v in items], pa.list_(pa.int64())), pa.array(mins, pa.int64()), pa.array(entries)], names=["digest", "ids", "min_id", "entry"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                table.setdefault(digest(normalise(t.as_buffer().to_pybytes())), []).append(i)
                held += 1
                if held >= memtable_rows:
                    yield flushed()
                    table, held = {}, 0
        if table:
            yield flushed()

    return run


def _shard(folder: str, memtable: int):
    def run(batches):
        index = MergeIndex(folder, memtable)
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("digest", "min_id", "entry", "n")]
            for d, m, e, n in zip(*cols):
                index.put(d, (NONE if m is None else m, e, n, 1))
        for part in batched(index.items(), 50_000):
            yield _rows([(d, None if m == NONE else m, e, n, k) for d, (m, e, n, k) in part])
        index.close()

    return run


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), Run.KINDS)], schema=Run.SCHEMA)


def _filter_of(hits: DataFrame, n_bits: int):
    """One Bloom filter of all digests; at most 64 tasks make their own of at most 8 MB, and the driver joins them one at a time."""

    def run(batches):
        bloom = Bloom(0)
        bloom.n_bits, bloom.bits = n_bits, bytearray(n_bits // 8 + 1)
        for batch in batches:
            for d in batch.column("digest").to_pylist():
                bloom.add(d)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([bytes(bloom.bits)], pa.binary())})

    bits = None
    for r in hits.select("digest").coalesce(64).mapInArrow(run, "bits binary").toLocalIterator():
        own = np.frombuffer(r["bits"], np.uint8)
        bits = own.copy() if bits is None else np.bitwise_or(bits, own, out=bits)
    bloom = Bloom(0)
    bloom.n_bits, bloom.bits = n_bits, bytearray(bits.tobytes() if bits is not None else n_bits // 8 + 1)
    return bloom


def _witnesses(digest: Callable[[bytes], bytes], bloom, memtable_bytes: int = 32 << 20):
    """Texts whose digest may be a hit, each text once a memtable; equal means equal bytes."""

    def run(batches):
        hits = bloom.value
        seen: dict[bytes, bytes] = {}
        held = 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], names=["digest", "text"])

        for batch in batches:
            for t in batch.column("text"):
                text = normalise(t.as_buffer().to_pybytes())
                d = digest(text)
                if text not in seen and d in hits:
                    seen[text] = d
                    held += len(text)
                    if held >= memtable_bytes:
                        yield flushed()
                        seen, held = {}, 0
        if seen:
            yield flushed()

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256, memtable_rows: int = 200_000, memtable: int = MEMTABLE) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The filter of hits has 12 bits for each up to 8 MB. Beyond, more texts pass it
    without being hits; they are moved and compared in vain, and no answer changes.
    """
    spark = docs.sparkSession
    texts = documents(docs, id_col, text_col)
    runs = materialize(texts.mapInArrow(_runs(digest, memtable_rows), RUN_SCHEMA), "runs")
    entries = runs.select("digest", "min_id", "entry", F.size("ids").cast("long").alias("n"))
    n_entries = runs.count()
    shards = max(1, -(-n_entries // SHARD_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_entries // 16_384)))
    index = materialize(entries.repartition(shards, "digest").mapInArrow(_shard(scratch_path(spark, "index-runs"), memtable), INDEX_SCHEMA), "index")

    hits = index.where("group_size > 1")
    n_hits = hits.count()
    bloom = spark.sparkContext.broadcast(_filter_of(hits, max(1 << 16, min(1 << 26, n_hits * 12))))
    witness = texts.mapInArrow(_witnesses(digest, bloom), "digest binary, text binary")
    collided = witness.groupBy("digest", "text").agg(F.lit(1).alias("x")).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    collided = materialize(collided, "collided")

    rows = _answers(runs, index, n_entries)
    if collided.head(1):
        rows = rows.join(collided, "digest", "left_anti").unionByName(_by_text(texts, collided, digest))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _answers(runs: DataFrame, index: DataFrame, n_entries: int) -> DataFrame:
    """Each row's group."""
    joined = spread_join(runs, index, "digest", "n_entries", n_entries)
    rows = joined.select("digest", "keep_id", "group_size", "entry", "keep_entry", "min_id", "ids", F.posexplode("ids").alias("pos", "doc_id"))
    first = F.coalesce(F.array_position("ids", F.col("min_id")), F.lit(1)) - 1
    return rows.select("digest", "doc_id", "keep_id", "group_size", ((F.col("entry") == F.col("keep_entry")) & (F.col("pos") == first)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _by_text(texts: DataFrame, collided: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Rows whose digest different texts share, grouped by the texts themselves."""

    def run(batches):
        for batch in batches:
            norm = [normalise(t.as_buffer().to_pybytes()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in norm], pa.binary()), batch.column("doc_id"), pa.array(norm, pa.binary())], names=["digest", "doc_id", "norm"])

    own = texts.mapInArrow(run, "digest binary, doc_id long, norm binary").join(collided, "digest", "left_semi")
    own = materialize(own.withColumn("entry", F.monotonically_increasing_id()), "collided-rows")
    least = own.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "entry")).alias("k"), F.count("*").alias("group_size"))
    return own.join(least, ["digest", "norm"]).select("digest", "doc_id", F.col("k.doc_id").alias("keep_id"), "group_size", (F.col("entry") == F.col("k.entry")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
