"""Table loading and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motrac.sources.scratch import materialize, scratch_path

__all__ = ["chunk_codes", "documents", "held", "materialize", "scratch_path", "spread_join", "table", "text_blocks", "windows"]


_HELD: dict = {}


def held(name, make):
    """What a Python worker remembers from task to task for one operator at a time.

    Workers live on from stage to stage; what another operator has left goes first,
    so that memories of several operators never add up.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
        _HELD[name] = make()
    return _HELD[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read, a null text as an empty one."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has one row a key and the number of rows that it meets, so that no key is hot.

    A key that meets over a 256th of total rows is broadcast: there are at most
    256 of them, whatever the size. All others meet in a plain join. Both frames are read
    more than once and should be written ones. how: inner, left or left_anti.
    """
    if total is None:
        total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = max(16, total // 256)
    often = keyed.where(F.col(count) > hot)
    if not often.head(1):
        return rows.join(keyed.select(key) if how == "left_anti" else keyed, key, how)
    often, others = F.broadcast(often), keyed.where(F.col(count) <= hot)
    rest = rows.join(often.select(key), key, "left_anti")
    if how == "left_anti":
        return rest.join(others.select(key), key, "left_anti")
    return rows.join(often, key).unionByName(rest.join(others, key, how))


_SPACE = b" \t\n\x0b\x0c\r"


def windows(data: bytes, width: int = 1 << 20):
    """Cut data at ASCII white space into parts of about width bytes.

    No word is divided, so very long texts are handled in bounded memory
    unless a single word is longer than that.
    """
    start, n = 0, len(data)
    while n - start > width:
        cut = start + width
        while cut < n and data[cut] not in _SPACE:
            cut += 1
        yield data[start:cut]
        start = cut
    if start < n:
        yield data[start:] if start else data


def text_blocks(texts, limit: int = 2 << 20):
    """Row ranges of an Arrow string array of about limit bytes each, one row at least."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo, n = 0, len(sizes)
    while lo < n:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, side="right"))
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    pa.default_memory_pool().release_unused()


def chunk_codes(texts):
    """The chunks between ASCII white space of each text: the distinct ones, their codes in order, and each text's end.

    Returns (distinct: list of str, codes: int32 array, offsets: int64 array of
    len(texts) + 1). An empty string may be among the distinct chunks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), offsets - offsets[0]
