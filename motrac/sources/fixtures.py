"""Adapters from general tables to the domain's: observations, features, pixels, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as cells: cell_id, traj_id, pos, frame, x, y, state, parent_id."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("cell_id"),
        F.col("user_id").alias("traj_id"),
        "ts",
        ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("int").alias("frame"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        "event_type",
    )
    w = Window.partitionBy("traj_id").orderBy("ts", "cell_id")
    codes = F.create_map(*[F.lit(v) for pair in (("click", 0), ("error", 1), ("purchase", 2), ("signup", 3), ("view", 4)) for v in pair])
    return e.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).withColumn("parent_id", F.lag("cell_id").over(w)).withColumn("state", F.coalesce(codes[F.col("event_type")], F.lit(-1))).drop("ts", "event_type")


OBS_SQL = """obs AS (
  SELECT event_id AS cell_id, user_id AS traj_id,
    CAST((day(ts) - 1) * 24 + hour(ts) AS INT) AS frame, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y,
    CAST(row_number() OVER w - 1 AS INT) AS pos, lag(event_id) OVER w AS parent_id,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS state
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a feature matrix: cell_id, xf, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("xf"), "label")


#: Discs of the synthetic masks: label, centre x at frame 0, centre y, radius, step of x per frame, first and last frame of each six.
DISCS = [(1, 6, 6, 3, 1, 0, 5), (2, 13, 6, 4, 0, 0, 5), (3, 24, 8, 5, -1, 0, 4), (5, 8, 20, 4, 1, 0, 5), (6, 17, 21, 5, 0, 0, 3), (7, 26, 24, 4, 0, 3, 5)]


def _disc_sql() -> str:
    return "CASE " + " ".join(f"WHEN frame % 6 BETWEEN {a} AND {b} AND (x - ({cx} + {step} * (frame % 6))) * (x - ({cx} + {step} * (frame % 6))) + (y - {cy}) * (y - {cy}) <= {r * r} THEN {k}" for k, cx, cy, r, step, a, b in DISCS) + " ELSE 0 END"


PIXEL_SQL = f"""pixels AS (SELECT frame, x, y, {_disc_sql()} AS label,
  CAST((x * 7 + y * 13 + frame * 3) % 101 AS DOUBLE) AS c1, CAST((x * x + 3 * y + frame * 5) % 97 AS DOUBLE) AS c2
  FROM (SELECT CAST(a.range AS INT) AS frame, CAST(b.range AS INT) AS x, CAST(c.range AS INT) AS y FROM range(6 * greatest(1, (SELECT count(*) // 150 FROM customer))) a, range(32) b, range(32) c))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 by 32 labelled pixels with two channels, six for every 150 customers: the movie grows with the tables."""
    frames = 6 * max(1, table(spark, sf_dir, "customer").count() // 150)
    grid = spark.range(frames * 1024).select(F.floor(F.col("id") / 1024).cast("int").alias("frame"), F.floor(F.col("id") % 1024 / 32).cast("int").alias("x"), (F.col("id") % 32).cast("int").alias("y"))
    return grid.select(
        "frame", "x", "y", F.expr(_disc_sql()).alias("label"),
        ((F.col("x") * 7 + F.col("y") * 13 + F.col("frame") * 3) % 101).cast("double").alias("c1"),
        ((F.col("x") * F.col("x") + 3 * F.col("y") + F.col("frame") * 5) % 97).cast("double").alias("c2"),
    )


#: Balls of the synthetic stacks: label, centre, radius, step of x per frame. The first two touch.
BALLS = [(1, 5, 5, 4, 3, 1), (2, 11, 6, 4, 3, 0), (4, 8, 14, 3, 2, 0)]


def _ball_sql() -> str:
    return "CASE " + " ".join(f"WHEN (x - ({a} + {s} * frame)) * (x - ({a} + {s} * frame)) + (y - {b}) * (y - {b}) + (z - {c}) * (z - {c}) <= {r * r} THEN {k}" for k, a, b, c, r, s in BALLS) + " ELSE 0 END"


VOXEL_SQL = f"""voxels AS (SELECT frame, x, y, z, {_ball_sql()} AS label, CAST((x * 5 + y * 3 + z * 7 + frame) % 31 AS DOUBLE) AS c1
  FROM (SELECT CAST(a.range AS INT) AS frame, CAST(b.range AS INT) AS x, CAST(c.range AS INT) AS y, CAST(d.range AS INT) AS z FROM range(2) a, range(18) b, range(18) c, range(8) d))"""


def voxels(spark: SparkSession) -> DataFrame:
    """Two stacks of 18 by 18 by 8 labelled voxels with a channel."""
    grid = spark.range(2 * 18 * 18 * 8).select(*[F.floor(F.col("id") / k % n).cast("int").alias(c) for c, k, n in (("frame", 2592, 2), ("x", 144, 18), ("y", 8, 18), ("z", 1, 8))])
    return grid.select("frame", "x", "y", "z", F.expr(_ball_sql()).alias("label"), ((F.col("x") * 5 + F.col("y") * 3 + F.col("z") * 7 + F.col("frame")) % 31).cast("double").alias("c1"))
