"""Bound-certified packing of token sequences.

Documents are cut only where they exceed the capacity. The pieces are dealt to
partitions of bounded size, each packed by best-fit decreasing. A lower bound
from dual-feasible functions certifies a partition whose number of bins equals
it. Partitions with a gap exchange all their documents; a certified one gives
those of its bins that are not full, as what each lacks another may have.
Best-fit decreasing is run again over what was exchanged, and a result is taken
only if it has fewer bins than came in, so no round makes a packing worse. The
exchange ends when no partition has a gap, when all sequences together are as
many as the bound of all pieces, when one partition holds all that is left, or
when partitions of the largest size have saved nothing.

A certified partition without some of its bins is still packed as well as can be:
that many sequences more would hold their pieces. So each row tells whether its
sequence is of a certified partition, and certificate() compares the whole.

Edge cases: a null or empty text is the end id alone (one piece of length 1);
repeated rows are packed each; rows with a null doc_id are packed like others;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import documents, materialize
from motrac.llm.tokens import default_path, encoder, with_end

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one partition packs in the first round; four times as many in each later one, up to what a task holds at once.
PARTITION_PIECES, MOST_PIECES = 4096, 1 << 18


def pieces(docs: DataFrame, tokenizer_path: str | None = None, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append end_id, and cut those over max_len."""
    path = tokenizer_path or default_path()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for lo, hi, ids, ends in enc.encode_array(batch.column("text")):
                ids, ends = with_end(ids, ends, end_id)
                data = memoryview(ids.tobytes())
                n = np.diff(ends)
                count = -(-n // max_len)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * max_len
                length = np.minimum(n[row] - start, max_len)
                at = ends[row] + start
                crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(at.tolist(), (at + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item's bin and offset. Ties of length keep their order.

    Open bins are kept by the room they have left, and a bit for each amount of
    room that some bin has finds the tightest one that fits in a few machine words.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n_bins = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = open_by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not open_by_room[left]:
                rooms |= 1 << left
            open_by_room[left].append(b)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int, max_k: int = 32) -> int:
    """Bins that any packing needs, from the number of items of each length 0..capacity.

    The largest of the sum of sizes, the functions u(k) that round a size times
    k + 1 down, and the functions that count sizes over capacity - e as whole
    bins and drop those under e. Whole-number arithmetic, so rounding is exact.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, max_k + 1):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    number, total = np.cumsum(counts), np.cumsum(counts * x)
    e = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    if len(e):
        best = max(best, int((large + -(-middle // capacity)).max()))
    return best


def _deal(seed: int, n: int, *cols):
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(n)).cast("int")


def _packer(cols: list[str], capacity: int, rnd: int):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["_part"].iloc[0])
        pdf = pdf.iloc[np.argsort(pdf["_uid"].to_numpy(), kind="stable")]
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        ids = (rnd << 52) + (part << 28) + bins
        if rnd and bins.max() + 1 >= pdf["sequence_id"].nunique():
            ids, offsets = pdf["sequence_id"].to_numpy(), pdf["offset"].to_numpy()
            bins = np.unique(ids, return_inverse=True)[1]
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        released = (fill < capacity) | (not certified)
        return pdf[cols].assign(sequence_id=ids, offset=offsets, certified=certified, _released=released[bins])

    return one


def pack(items: DataFrame, capacity: int = 4096, partition_pieces: int = PARTITION_PIECES, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Place rows with a length of 1..capacity in sequences: adds sequence_id, offset and certified.

    Each round is written to the shared folder. A round deals whole bins to
    partitions of partition_pieces rows, four times as many each time up to most_pieces.
    """
    cols = items.columns
    pool = materialize(items.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    out_schema = f"{fields}, _uid long, sequence_id long, offset long, certified boolean, _released boolean"
    bound = global_bound(pool, capacity)
    done: list[DataFrame] = []
    rows, settled, before = pool.count(), 0, None
    for rnd in range(1 << 11):
        size = max(1, min(partition_pieces << 2 * min(rnd, 16), max(partition_pieces, most_pieces)))
        parts = max(1, -(-rows // size))
        dealt = pool.withColumn("_part", _deal(rnd, parts, "_uid" if rnd == 0 else "sequence_id"))
        packed = materialize(dealt.groupBy("_part").applyInPandas(_packer([*cols, "_uid"], capacity, rnd), out_schema), f"packed-{rnd}")
        first = F.col("offset") == 0
        r = packed.agg(F.count_if(first).alias("bins"), F.count_if(first & ~F.col("_released")).alias("kept"), F.count_if("_released").alias("rows")).first()
        stuck = size >= most_pieces and before is not None and r["bins"] >= before
        if parts == 1 or not r["rows"] or settled + r["bins"] == bound or stuck:
            done.append(packed)
            break
        done.append(packed.where("not _released"))
        settled, before, rows = settled + r["kept"], r["bins"] - r["kept"], r["rows"]
        pool = packed.where("_released")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*cols, "sequence_id", "offset", "certified")


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """(sequences, fewest that any packing of these rows needs); equal numbers prove the packing best."""
    return packed.where("offset = 0").count(), global_bound(packed, capacity)


def global_bound(items: DataFrame, capacity: int = 4096) -> int:
    """The lower bound for all rows together; at most capacity counts reach the driver."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts, capacity)


def best_fit_packing(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Encode, cut and pack whole texts: PIECE_SCHEMA with sequence_id, offset and certified."""
    return pack(pieces(docs, tokenizer_path, capacity, end_id), capacity)
