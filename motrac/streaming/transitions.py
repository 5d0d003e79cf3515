"""An extension: transition counts of trajectories whose observations arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from motrac.sources.scratch import scratch_path

STEP_SCHEMA = "traj_id long, i int, j int, late long"
STATE_SCHEMA = "pos int, state int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Steps from the last known position on; positions at or before it come late and are counted in a row of their own."""
    rows = pd.concat(list(batches)).sort_values("pos", kind="stable")
    last = state.get if state.exists else None
    if last is not None:
        late = int((rows["pos"] <= last[0]).sum())
        rows = rows[rows["pos"] > last[0]]
        if late:
            yield pd.DataFrame({"traj_id": [key[0]], "i": pd.array([None], "Int32"), "j": pd.array([None], "Int32"), "late": [late]})
    if rows.empty:
        return
    states = rows["state"].astype(int).tolist()
    before = ([last[1]] if last is not None else []) + states[:-1]
    state.update((int(rows["pos"].iloc[-1]), states[-1]))
    after = states if last is not None else states[1:]
    yield pd.DataFrame({"traj_id": [key[0]] * len(after), "i": before, "j": after, "late": 0}).astype({"traj_id": "int64", "i": "int32", "j": "int32", "late": "int64"})


def steps(stream: DataFrame) -> DataFrame:
    """Steps (traj_id, i, j, late = 0) of a stream of (traj_id, pos, state); rows without i and j tell how many came late."""
    return stream.groupBy("traj_id").applyInPandasWithState(_advance, STEP_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def replay(series: DataFrame, files: int = 3) -> DataFrame:
    """The stream over a finished table, cut in files by position; returns the counts (i, j, n)."""
    spark = series.sparkSession
    source, sink, mark = (scratch_path(spark, t) for t in ("arrivals", "steps", "progress"))
    for k in range(files):
        part = F.floor(F.col("pos") / 20) if k < files - 1 else None
        rows = series.where(part == k) if part is not None else series.where(F.floor(F.col("pos") / 20) >= files - 1)
        rows.select("traj_id", "pos", "state").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("traj_id long, pos int, state int").option("maxFilesPerTrigger", 1).parquet(source)
    q = steps(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(STEP_SCHEMA).parquet(sink).where("i is not null").groupBy("i", "j").agg(F.count("*").alias("n"))
