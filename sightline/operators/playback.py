"""Points frame by frame for viewers, boxes around detections, and samples of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.places import numbered
from sightline.schema import POINT, STATIC_SYNC_INDEX, WORLD_KEY

XYZ = ("x_coord", "y_coord", "z_coord")


def playback(world: DataFrame) -> DataFrame:
    """(sync_index, object_id, keypoint_id, place, x.., y.., z..): every point in every frame, null where it
    isn't seen; static points stand in all frames and win over moving ones. Points are as many as the objects have."""
    moving, static = world.filter(F.col("sync_index") != STATIC_SYNC_INDEX), world.filter(F.col("sync_index") == STATIC_SYNC_INDEX)
    points = world.select(*POINT).distinct().withColumn("place", F.row_number().over(Window.orderBy(*POINT)) - 1)
    points = points.join(static.select(*POINT, *(F.col(c).alias(f"_{c}") for c in XYZ)).dropDuplicates(list(POINT)), list(POINT), "left")
    grid = moving.select("sync_index").distinct().crossJoin(F.broadcast(points))
    full = grid.join(moving.select(*WORLD_KEY, *XYZ), list(WORLD_KEY), "left")
    return full.select(*WORLD_KEY, "place", *(F.coalesce(f"_{c}", c).alias(c) for c in XYZ))


def evenly_spaced(frames: DataFrame, n: int) -> DataFrame:
    """(sync_index): n distinct frames from the first to the last in even steps, all if there are fewer."""
    if n <= 0:
        raise ValueError("the number of frames must be positive")
    own = frames.select("sync_index").distinct()
    placed = numbered(own, "sync_index", name="_i")
    count = own.agg(F.count("*").alias("_n"))
    steps = count.select("_n", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))).alias("_k"))
    at = F.when(F.col("_n") <= n, F.lit(None)).otherwise(F.rint(F.col("_k") * (F.col("_n") - 1) / max(1, n - 1)).cast("long"))
    wanted = steps.select(at.alias("_i")).filter("_i is not null").distinct()
    every = count.filter(F.col("_n") <= n).select(F.lit(True).alias("_all"))
    few = placed.crossJoin(F.broadcast(every)).select("sync_index")
    return placed.join(F.broadcast(wanted), "_i", "left_semi").select("sync_index").unionByName(few)


def padded_boxes(detections: DataFrame, keys: tuple[str, ...], threshold: float, aspect: float, width: int, height: int, padding: float = 0.3) -> DataFrame:
    """(keys, x1, y1, x2, y2): the box of confident points, padded on each side, widened to an aspect and cut
    to the image, at least a pixel wide; the whole image where no point is confident."""
    sure = F.col("confidence") >= threshold
    edge = lambda f, c: f(F.when(sure, F.col(c)))
    box = detections.groupBy(*keys).agg(edge(F.min, "x").alias("x0"), edge(F.max, "x").alias("x9"), edge(F.min, "y").alias("y0"), edge(F.max, "y").alias("y9"))
    w, h = (F.col("x9") - F.col("x0")) * (1 + 2 * padding), (F.col("y9") - F.col("y0")) * (1 + 2 * padding)
    wide = w / F.greatest(h, F.lit(1.0)) > aspect
    bw, bh = F.when(wide, w).otherwise(h * aspect), F.when(wide, w / aspect).otherwise(h)
    cx, cy = (F.col("x0") + F.col("x9")) / 2, (F.col("y0") + F.col("y9")) / 2
    cut = lambda v: v.cast("long")
    out = box.select(*keys, cut(F.greatest(F.lit(0.0), cx - bw / 2)).alias("x1"), cut(F.greatest(F.lit(0.0), cy - bh / 2)).alias("y1"), cut(F.least(F.lit(float(width)), cx + bw / 2)).alias("x2"), cut(F.least(F.lit(float(height)), cy + bh / 2)).alias("y2"), F.col("x0").isNull().alias("_none"))
    grown = lambda a, b, most: F.when(F.col(b) <= F.col(a), F.least(F.col(a) + 1, F.lit(most))).otherwise(F.col(b))
    none = F.col("_none")
    return out.select(
        *keys, F.when(none, 0).otherwise(F.col("x1")).cast("long").alias("x1"), F.when(none, 0).otherwise(F.col("y1")).cast("long").alias("y1"),
        F.when(none, width).otherwise(grown("x1", "x2", width)).cast("long").alias("x2"), F.when(none, height).otherwise(grown("y1", "y2", height)).cast("long").alias("y2"),
    )
