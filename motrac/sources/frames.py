"""Frames and metadata on disk: Parquet by frame, image files as bytes, HDF5 where h5py is installed."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_frames(px: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pixels in a folder a frame; an existing target is an error unless overwrite is set."""
    px.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("frame").parquet(path)


def append_frame(px: DataFrame, path: str, frame: int, overwrite: bool = False) -> None:
    """One more frame; if it is there already that is an error, or it alone is replaced."""
    spark = px.sparkSession
    target = f"{path}/frame={frame}"
    px.where(F.col("frame") == frame).drop("frame").write.mode("overwrite" if overwrite else "errorifexists").parquet(target)
    spark.catalog.refreshByPath(path)


def read_frames(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pixels of frames first..last; only those folders are read."""
    px = spark.read.parquet(path)
    if first is not None:
        px = px.where(F.col("frame") >= first)
    return px if last is None else px.where(F.col("frame") <= last)


def list_images(spark: SparkSession, glob: str) -> DataFrame:
    """Files of a pattern with their sizes, in name order; their bytes are not read."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "modificationTime").orderBy("path")


def read_images(spark: SparkSession, glob: str) -> DataFrame:
    """Files of a pattern as bytes."""
    return spark.read.format("binaryFile").load(glob).select("path", "content")


def save_metadata(spark: SparkSession, values: dict, path: str, overwrite: bool = False) -> None:
    """A nested dictionary as rows (key, json); lists and numbers keep their kind."""
    rows = [(k, json.dumps(v, sort_keys=True)) for k, v in sorted(values.items())]
    spark.createDataFrame(rows, "key string, json string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    return {r["key"]: json.loads(r["json"]) for r in spark.read.parquet(path).collect()}


def read_hdf5(spark: SparkSession, glob: str, dataset: str = "images/img_{frame}/image") -> DataFrame:
    """Pixels (path, frame, x, y, value) of movies in HDF5, a file a task. Needs h5py on the executors."""

    def run(batches):
        import io

        import h5py
        import numpy as np

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                with h5py.File(io.BytesIO(content), "r") as f:
                    frame = 0
                    while dataset.format(frame=frame) in f:
                        img = np.asarray(f[dataset.format(frame=frame)], float)
                        y, x = np.mgrid[: img.shape[0], : img.shape[1]]
                        yield pd.DataFrame({"path": path, "frame": frame, "x": x.ravel(), "y": y.ravel(), "value": img.reshape(img.shape[0], img.shape[1], -1)[:, :, 0].ravel()})
                        frame += 1

    return read_images(spark, glob).mapInPandas(run, "path string, frame int, x int, y int, value double")


def treatments(tables: dict[str, DataFrame]) -> DataFrame:
    """Several data sets as one table with the name of each row's set as treatment; columns that a set lacks are null there."""
    out = None
    for name, df in sorted(tables.items()):
        own = df.withColumn("treatment", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no data set was given")
    return out


def save_table(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """Writes a table; 0 if it was written, 1 if the target is there and overwrite is not set."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    except AnalysisException:
        return 1
    return 0
