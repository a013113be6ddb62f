"""Extrinsic calibration from observations of known objects: bootstrap, adjust, drop the worst, adjust again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators import bundle, coverage, poses, quality, reconstruction
from sightline.schema import CAMERAS


@dataclass(frozen=True)
class Calibration:
    points: DataFrame
    world: DataFrame
    cameras: DataFrame
    anchor: int
    rmse: float


def bootstrap(points: DataFrame, cameras: DataFrame) -> tuple[int, DataFrame]:
    """(anchor, cameras): poses of all cameras that objects seen together link, relative to the best anchor."""
    spark = points.sparkSession
    und = reconstruction.undistort(points, cameras)
    pairs = coverage.pair_correspondences(und.withColumns({"img_loc_x": F.col("und_x"), "img_loc_y": F.col("und_y")}))
    anchor, found = poses.pose_network(und, cameras, pairs).anchored()
    rows = [(c, *map(float, e.r.reshape(-1)), *map(float, e.t)) for c, e in found.items()]
    names = [*(f"r{i}" for i in range(9)), "t0", "t1", "t2"]
    posed = spark.createDataFrame(rows, "cam_id long, " + ", ".join(f"_{n} double" for n in names))
    out = cameras.join(F.broadcast(posed), "cam_id", "left")
    return anchor, out.select(*(F.col(f"_{c}").alias(c) if c in names else F.col(c) for c in CAMERAS.names))


def calibrate(points: DataFrame, cameras: DataFrame, static_objects: Iterable[int] = (), worst_percent: float = 2.5, robust: float = 1.0, rounds: int = 10) -> Calibration:
    """Poses from nothing but lenses and observations with places in their objects; the anchor is the origin."""
    static = list(static_objects)
    anchor, rig = bootstrap(points, cameras)
    world = reconstruction.triangulate(points, rig, static)
    first = bundle.adjust(points, world, rig, static, rounds)
    second = bundle.adjust(points, first.world, first.cameras, static, rounds, robust)
    errors = reconstruction.residuals(points, second.world, second.cameras, static)
    kept, world = reconstruction.apply_filter(points, second.world, reconstruction.without_worst(errors, worst_percent), static)
    last = bundle.adjust(kept, world, second.cameras, static, rounds)
    return Calibration(kept, last.world, last.cameras, anchor, last.rmse)


def constrains_lenses(world: DataFrame, cameras: DataFrame, least: float = 2.0) -> DataFrame:
    """(cam_id, depth_ratio, enough): whether each camera sees enough depth to adjust its lens too; null is not enough."""
    return quality.depth_ratios(world, cameras).select("cam_id", "depth_ratio", F.coalesce(F.col("depth_ratio") >= least, F.lit(False)).alias("enough"))
