"""Distance constraints of markers and boards, compiled from their corner tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corners of a marker of side 1, from the top left, clockwise, y up.
CORNERS = ((-0.5, 0.5), (0.5, 0.5), (0.5, -0.5), (-0.5, -0.5))


def marker_corners(markers: DataFrame) -> DataFrame:
    """(object_id, keypoint_id, obj_loc_x/y/z) of markers (object_id, side)."""
    unit = F.array(*(F.struct(F.lit(i).cast("long").alias("keypoint_id"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (x, y) in enumerate(CORNERS)))
    rows = markers.select("object_id", "side", F.inline(unit))
    return rows.select("object_id", "keypoint_id", (F.col("x") * F.col("side")).alias("obj_loc_x"), (F.col("y") * F.col("side")).alias("obj_loc_y"), F.lit(0.0).alias("obj_loc_z"))


def board_corners(spark: SparkSession, columns: int, rows: int, pitch: float, object_id: int = 0, y_down: bool = True) -> DataFrame:
    """A grid of corners, row by row."""
    grid = spark.range(columns * rows)
    sign = -1.0 if y_down else 1.0
    return grid.select(F.lit(object_id).cast("long").alias("object_id"), F.col("id").alias("keypoint_id"), ((F.col("id") % columns) * pitch).alias("obj_loc_x"), (F.expr(f"id div {columns}") * pitch * sign).alias("obj_loc_y"), F.lit(0.0).alias("obj_loc_z"))


def _distances(a: DataFrame, b: DataFrame, on: F.Column, sigma: float) -> DataFrame:
    d = F.sqrt(sum(((F.col(f"a.obj_loc_{c}") - F.col(f"b.obj_loc_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return a.alias("a").join(b.alias("b"), on).select(
        F.col("a.object_id").alias("object_id_a"), F.col("a.keypoint_id").alias("keypoint_id_a"), F.col("b.object_id").alias("object_id_b"),
        F.col("b.keypoint_id").alias("keypoint_id_b"), d.alias("distance"), F.lit(sigma).alias("sigma"),
    )


def marker_constraints(markers: DataFrame, sigma: float = 0.001) -> DataFrame:
    """The six distances within each marker; a marker has four corners, so the pairs are bounded."""
    c = marker_corners(markers)
    return _distances(c, c, (F.col("a.object_id") == F.col("b.object_id")) & (F.col("a.keypoint_id") < F.col("b.keypoint_id")), sigma)


def board_truss(spark: SparkSession, columns: int, rows: int, pitch: float, sigma: float = 0.001) -> DataFrame:
    """Neighbours to the right and below, diagonals of each cell, and six braces between the outer corners."""
    near = spark.range(columns * rows).select(F.col("id").alias("p"), (F.col("id") % columns).alias("c"), F.expr(f"id div {columns}").alias("r"))
    step = lambda dc, dr: F.struct(F.lit(dc).alias("dc"), F.lit(dr).alias("dr"))
    edges = near.select("p", "c", "r", F.inline(F.array(step(1, 0), step(0, 1), step(1, 1), step(-1, 1))))
    edges = edges.filter((F.col("c") + F.col("dc")).between(0, columns - 1) & (F.col("r") + F.col("dr") < rows)).select(F.col("p").alias("a"), (F.col("p") + F.col("dc") + F.col("dr") * columns).alias("b"))
    outer = [0, columns - 1, columns * (rows - 1), columns * rows - 1]
    braces = spark.createDataFrame([(outer[i], outer[j]) for i in range(4) for j in range(i + 1, 4)], "a long, b long")
    x = lambda k: F.col(k) % columns
    y = lambda k: F.floor(F.col(k) / columns)
    both = edges.unionByName(braces).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.select(F.col("a").alias("keypoint_id_a"), F.col("b").alias("keypoint_id_b"), (F.hypot(x("a") - x("b"), y("a") - y("b")) * pitch).alias("distance"), F.lit(sigma).alias("sigma"))


def mirrored_corners(pairs: DataFrame) -> DataFrame:
    """(object_id_from, keypoint_id_from, object_id_to, keypoint_id_to): corners a + k of one face lie
    behind corners b - k of the other. ``pairs``: object_id_a, corner_a, object_id_b, corner_b."""
    rows = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    turn = lambda e: F.pmod(e, F.lit(4)).cast("long")
    return rows.select(F.col("object_id_a").alias("object_id_from"), turn(F.col("corner_a") + F.col("k")).alias("keypoint_id_from"), F.col("object_id_b").alias("object_id_to"), turn(F.col("corner_b") - F.col("k")).alias("keypoint_id_to"))


def integrity_problems(markers: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(problem, object_id): links to markers that don't exist, repeated links, and markers in two mirror pairs."""
    ends = links.select(F.explode(F.array("object_id_a", "object_id_b")).alias("object_id"))
    unknown = ends.join(markers.select("object_id"), "object_id", "left_anti").distinct().select(F.lit("unknown marker").alias("problem"), "object_id")
    same = links.select(F.least("object_id_a", "object_id_b").alias("object_id"), F.greatest("object_id_a", "object_id_b").alias("o")).groupBy("object_id", "o").agg(F.count("*").alias("n")).filter("n > 1")
    faces = pairs.select(F.explode(F.array("object_id_a", "object_id_b")).alias("object_id")).groupBy("object_id").agg(F.count("*").alias("n")).filter("n > 1")
    return unknown.unionByName(same.select(F.lit("repeated link").alias("problem"), "object_id")).unionByName(faces.select(F.lit("two mirror pairs").alias("problem"), "object_id"))
