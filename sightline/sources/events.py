"""The two relations as views of an event table and of closed formulas, in Spark and in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_OF = "CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END"

#: Observations: 40 events make a frame; camera and keypoint come from the user, pixels from the value.
OBSERVATIONS_SQL = f"""
SELECT CAST(event_id // 40 AS BIGINT) AS sync_index, CAST(user_id % 4 AS BIGINT) AS cam_id, CAST({OBJECT_OF} AS BIGINT) AS object_id,
       CAST((user_id // 4) % 4 AS BIGINT) AS keypoint_id, min(value) * 3.5 + 20.0 AS img_loc_x, max(value) * 2.0 + 10.0 AS img_loc_y,
       CAST((user_id // 4) % 4 % 2 AS DOUBLE) * 0.05 AS obj_loc_x, CAST((user_id // 4) % 4 // 2 AS DOUBLE) * 0.05 AS obj_loc_y,
       CAST(NULL AS DOUBLE) AS obj_loc_z, CAST(min(event_id) AS DOUBLE) / 1200.0 AS frame_time
FROM events GROUP BY event_id // 40, user_id % 4, {OBJECT_OF}, (user_id // 4) % 4
"""

#: World points: a square of four that circles, one for each point observed in a frame.
WORLD_SQL = """
SELECT sync_index, object_id, keypoint_id,
       0.05 * CAST(keypoint_id % 2 AS DOUBLE) + 0.3 * cos(0.05 * CAST(sync_index AS DOUBLE)) + 0.2 * CAST(object_id AS DOUBLE) AS x_coord,
       0.05 * CAST(keypoint_id // 2 AS DOUBLE) + 0.3 * sin(0.05 * CAST(sync_index AS DOUBLE)) AS y_coord,
       0.5 + 0.1 * CAST(object_id AS DOUBLE) + 0.02 * CAST(keypoint_id AS DOUBLE) AS z_coord, min(frame_time) AS frame_time
FROM obs GROUP BY sync_index, object_id, keypoint_id
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kp = F.expr("(user_id div 4) % 4")
    grouped = e.groupBy(
        F.expr("event_id div 40").alias("sync_index"), (F.col("user_id") % 4).alias("cam_id"), F.expr(OBJECT_OF).cast("long").alias("object_id"), kp.alias("keypoint_id")
    ).agg((F.min("value") * 3.5 + 20.0).alias("img_loc_x"), (F.max("value") * 2.0 + 10.0).alias("img_loc_y"), F.min("event_id").alias("_first"))
    return grouped.select(
        "sync_index", "cam_id", "object_id", "keypoint_id", "img_loc_x", "img_loc_y", ((F.col("keypoint_id") % 2).cast("double") * 0.05).alias("obj_loc_x"),
        (F.expr("keypoint_id div 2").cast("double") * 0.05).alias("obj_loc_y"), F.lit(None).cast("double").alias("obj_loc_z"), (F.col("_first").cast("double") / 1200.0).alias("frame_time"),
    )


def world(obs: DataFrame) -> DataFrame:
    s, o, k = (F.col(c).cast("double") for c in ("sync_index", "object_id", "keypoint_id"))
    keys = obs.groupBy("sync_index", "object_id", "keypoint_id").agg(F.min("frame_time").alias("frame_time"))
    return keys.select(
        "sync_index", "object_id", "keypoint_id",
        (0.05 * (F.col("keypoint_id") % 2).cast("double") + 0.3 * F.cos(0.05 * s) + 0.2 * o).alias("x_coord"),
        (0.05 * F.expr("keypoint_id div 2").cast("double") + 0.3 * F.sin(0.05 * s)).alias("y_coord"),
        (0.5 + 0.1 * o + 0.02 * k).alias("z_coord"), "frame_time",
    )
