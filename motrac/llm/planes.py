"""Token ids in files of bit or byte planes.

A file holds documents in order. Their ids, one after the other, are cut into
blocks of a fixed number; a block's 32-bit ids are transposed into 4 byte planes
or 32 bit planes, and each plane is compressed with zstandard by itself. A chunk
index tells where each block begins, so that any id range is read without the rest.

Layout, all numbers little-endian:
  magic "TPLANE01"
  chunks: for each plane its compressed bytes
  chunk index: for each chunk u64 offset, u32 ids, then u32 length of each plane
  document index: zstandard of i64 doc_id, u8 1 where doc_id is known, i64 tokens, column by column
  footer: u64 offset of chunk index, u32 chunks, u64 offset of document index, u32 documents, u8 planes, magic

Edge cases: a null or empty text is the end id alone; repeated rows and null ids
are stored each (nulls first); an empty table gives no file and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motrac.llm.common import documents, materialize, scratch_path
from motrac.llm.tokens import default_path, encoder, with_end

MAGIC = b"TPLANE01"
FOOTER = struct.Struct("<QIQIB8s")
INDEX_SCHEMA = "shard int, path string, n_docs long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in octets]
    return [np.packbits(octets[k // 8] >> (k % 8) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            octets[k] = np.frombuffer(p, np.uint8, n)
    else:
        for k, p in enumerate(planes):
            octets[k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), count=n) << (k % 8)
    return np.ascontiguousarray(octets.T).reshape(-1).view("<u4")


class PlaneWriter:
    """Writes ids as they come; holds one block and 17 bytes a document."""

    def __init__(self, sink, block: int = 1 << 16, bits: bool = False, level: int = 3):
        self.sink, self.block, self.bits = sink, block, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held, self.at = 0, len(MAGIC)
        self.chunks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.n_tokens = 0
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), known.astype(np.uint8), sizes.astype("<i8")))
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(ids[i : i + self.block])
            self.waiting = [ids[whole:].copy()]
            self.held = len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.sink.write(p)
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.held:
            self._chunk(np.concatenate(self.waiting))
        index_at = self.at
        for at, n, sizes in self.chunks:
            data = struct.pack("<QI", at, n) + struct.pack(f"<{len(sizes)}I", *sizes)
            self.sink.write(data)
            self.at += len(data)
        docs_at = self.at
        data = self.zip.compress(b"".join(np.concatenate([d[k] for d in self.docs]).tobytes() for k in range(3)) if self.docs else b"")
        self.sink.write(data)
        self.sink.write(FOOTER.pack(index_at, len(self.chunks), docs_at, self.n_docs, 32 if self.bits else 4, MAGIC))


class PlaneReader:
    """Reads a file's indexes at once and its chunks when asked."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - FOOTER.size, FOOTER.size)
        index_at, n_chunks, docs_at, n_docs, planes, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a token plane file")
        width = 12 + 4 * planes
        index = self._read(index_at, width * n_chunks)
        self.chunks = [(*struct.unpack_from("<QI", index, i * width), struct.unpack_from(f"<{planes}I", index, i * width + 12)) for i in range(n_chunks)]
        self.first = np.cumsum([0, *[n for _, n, _ in self.chunks]])
        data = zstandard.ZstdDecompressor().decompress(self._read(docs_at, size - FOOTER.size - docs_at), max_output_size=max(1, 17 * n_docs)) if n_docs else b""
        self.doc_ids = np.frombuffer(data, "<i8", n_docs)
        self.known = np.frombuffer(data, np.uint8, n_docs, 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(data, "<i8", n_docs, 9 * n_docs)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        data, unzip, planes = self._read(at, sum(sizes)), zstandard.ZstdDecompressor(), []
        for s in sizes:
            planes.append(unzip.decompress(data[:s]))
            data = data[s:]
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop, from the chunks that hold them only."""
        a, b = np.searchsorted(self.first, [start, stop - 1], side="right") - 1 if stop > start else (0, -1)
        parts = [self.chunk(k)[max(0, start - self.first[k]) : stop - self.first[k]] for k in range(a, b + 1)]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def crcs(self):
        """crc32 of each document's ids, in order, a chunk in memory at a time."""
        left, crc, doc = int(self.sizes[0]) if len(self.sizes) else 0, 0, 0
        for k in range(len(self.chunks)):
            data, at = memoryview(self.chunk(k).tobytes()), 0
            while at < len(data):
                take = min(left * 4, len(data) - at)
                crc = zlib.crc32(data[at : at + take], crc)
                at, left = at + take, left - take // 4
                if not left:
                    yield crc
                    doc, crc = doc + 1, 0
                    left = int(self.sizes[doc]) if doc < len(self.sizes) else 0


def write_planes(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 1, block: int = 1 << 16, bits: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write files in ascending doc_id order, one a task; returns the index of the files.

    A task writes under a name of its own; only files that the written index
    names count, so a task run twice after a lost executor does no harm. Files
    of this run that no index row names are removed at the end; other files in
    the folder stay. Rows that share a doc_id, or have none, are told apart by
    their place in the input, so that they can be dealt to several tasks.
    """
    path, own = tokenizer_path or default_path(), uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, out = encoder(path), None
        for batch in batches:
            for lo, hi, ids, ends in enc.encode_array(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"tokens-{own}-{shard:06d}-{uuid.uuid4().hex}.tpl"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    out = PlaneWriter(sink, block, bits)
                keys = batch.column("doc_id").slice(lo, hi - lo)
                out.add(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": pa.array([out.n_docs], pa.int64()), "n_tokens": pa.array([out.n_tokens], pa.int64())})

    placed = documents(docs, id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place")
    index = materialize(ordered.mapInArrow(run, INDEX_SCHEMA), "plane-index")
    live = {r["path"].rsplit("/", 1)[1] for r in index.select("path").toLocalIterator()}
    fs, base = pafs.FileSystem.from_uri(folder)
    for info in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if info.is_file and info.base_name.startswith(f"tokens-{own}-") and info.base_name not in live:
            fs.delete_file(info.path)
    return index


def read_planes(index: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, from the files alone.

    Where a file's ids begin among all comes from the index of files, which is
    read with the file names; no document meets the index again.
    """

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(name) as f:
                    r = PlaneReader(f, f.size())
                    crc = np.fromiter(r.crcs(), np.int64, len(r.sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.doc_ids, pa.int64(), mask=~r.known), pa.array(row["base"] + np.cumsum(r.sizes) - r.sizes), pa.array(r.sizes), pa.array(crc)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = index.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return files.repartition(max(1, index.count()), "shard").select("path", "base").mapInArrow(run, READ_SCHEMA)


def plane_round_trip(docs: DataFrame, folder: str | None = None, **kw) -> DataFrame:
    """Write the files and read them back."""
    return read_planes(write_planes(docs, folder or scratch_path(docs.sparkSession, "planes"), **kw))
