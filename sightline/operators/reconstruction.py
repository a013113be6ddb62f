"""From pixels to points and back: undistortion, triangulation, projection, residuals and filters on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import geometry as G
from sightline.operators.filters import collapse_static, posed
from sightline.operators.quantiles import quantiles
from sightline.sources.checkpoints import use_checkpoints
from sightline.schema import IMAGE_KEY, POINT, STATIC_SYNC_INDEX, WORLD_KEY


def with_camera(points: DataFrame, cameras: DataFrame, only_posed: bool = True) -> DataFrame:
    """Observations with their camera's columns; a rig has tens of cameras, which go to each task."""
    rig = posed(cameras) if only_posed else cameras
    return points.join(F.broadcast(rig.drop("width", "height", "ignored")), "cam_id")


def _without_distortion(u, v, k: dict, steps: int):
    """Arrays of normalised coordinates without the distortion of a Brown-Conrady lens, by fixed-point steps."""
    a, b = u, v
    for _ in range(steps):
        r2 = a * a + b * b
        radial = 1 + r2 * (k["k1"] + r2 * (k["k2"] + r2 * k["k3"]))
        dx = 2 * k["p1"] * a * b + k["p2"] * (r2 + 2 * a * a)
        dy = k["p1"] * (r2 + 2 * b * b) + 2 * k["p2"] * a * b
        a, b = (u - dx) / radial, (v - dy) / radial
    return a, b


def _without_fisheye(u, v, k: dict, steps: int):
    """The same for an equidistant lens: Newton steps for the angle whose bent value is the radius."""
    import numpy as np

    bent = np.minimum(np.hypot(u, v), np.pi / 2)
    t = bent
    for _ in range(steps):
        t2 = t * t
        value = t * (1 + t2 * (k["k1"] + t2 * (k["k2"] + t2 * (k["p1"] + t2 * k["p2"])))) - bent
        t = t - value / (1 + t2 * (3 * k["k1"] + t2 * (5 * k["k2"] + t2 * (7 * k["p1"] + t2 * 9 * k["p2"]))))
    scale = np.where(bent > 1e-12, np.tan(t) / np.maximum(bent, 1e-12), 1.0)
    return u * scale, v * scale


def undistort(points: DataFrame, cameras: DataFrame, steps: int = 20) -> DataFrame:
    """Observations with und_x, und_y, normalised image coordinates without distortion, null
    where a pixel is null; of both kinds of lenses. Cameras without intrinsics are left out.

    One Arrow pass over batches; the inverse has no closed form.
    """
    import pyarrow as pa

    names = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")
    lenses = cameras.filter("fx is not null").select("cam_id", F.coalesce("fisheye", F.lit(False)).alias("_fisheye"), *(F.coalesce(n, F.lit(0.0)).alias(f"_{n}") for n in names))
    rows = points.join(F.broadcast(lenses), "cam_id").select(*points.columns, "_fisheye", *(f"_{n}" for n in names))
    kept = points.columns

    def work(batches):
        import numpy as np

        for batch in batches:
            k = {n: batch.column(f"_{n}").to_numpy() for n in names}
            u, v = ((batch.column(f"img_loc_{c}").to_numpy(zero_copy_only=False) - k[f"c{c}"]) / k[f"f{c}"] for c in "xy")
            a, b = np.empty(len(u)), np.empty(len(u))
            fisheye = batch.column("_fisheye").to_numpy(zero_copy_only=False).astype(bool)
            for which, inverse in ((~fisheye, _without_distortion), (fisheye, _without_fisheye)):
                if which.any():
                    a[which], b[which] = inverse(u[which], v[which], {n: x[which] for n, x in k.items()}, steps)
            out = [batch.column(n) for n in kept] + [pa.array(a, from_pandas=True), pa.array(b, from_pandas=True)]
            yield pa.record_batch(out, names=[*kept, "und_x", "und_y"])

    return rows.mapInArrow(work, T.StructType([*points.schema.fields, T.StructField("und_x", T.DoubleType()), T.StructField("und_y", T.DoubleType())]))


def triangulate(points: DataFrame, cameras: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """World points of everything seen at least twice by posed cameras.

    Each observation adds two rows to a point's linear system; their products are ten sums,
    combined before the shuffle, so that a static point seen in every frame is no hot key.
    One Arrow pass then takes the eigenvector of the smallest eigenvalue for each batch.
    The frame's time is the mean over all its rows, null for static points. Points at
    infinity have null coordinates.
    """
    static = list(static_objects)
    rows = collapse_static(undistort(points, posed(cameras)), static)
    rows = rows.join(F.broadcast(posed(cameras).select("cam_id", *(f"r{i}" for i in range(9)), "t0", "t1", "t2")), "cam_id")
    p = lambda i: [F.col(f"r{3 * i}"), F.col(f"r{3 * i + 1}"), F.col(f"r{3 * i + 2}"), F.col(f"t{i}")]
    one = [F.col("und_x") * c - a for a, c in zip(p(0), p(2))]
    two = [F.col("und_y") * c - b for b, c in zip(p(1), p(2))]
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = rows.groupBy(*WORLD_KEY).agg(F.count("*").alias("n_views"), *(F.sum(one[i] * one[j] + two[i] * two[j]).alias(f"m{i}{j}") for i, j in cells)).filter("n_views >= 2")

    def solve(batches):
        import numpy as np

        for pdf in batches:
            m = np.empty((len(pdf), 4, 4))
            for i, j in cells:
                m[:, i, j] = m[:, j, i] = pdf[f"m{i}{j}"]
            v = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.empty((0, 4))
            far = np.abs(v[:, 3]) < 1e-12
            out = pdf[[*WORLD_KEY, "n_views"]].copy()
            for k, c in enumerate(("x_coord", "y_coord", "z_coord")):
                out[c] = np.where(far, np.nan, v[:, k] / np.where(far, 1.0, v[:, 3]))
            yield out

    found = sums.mapInPandas(solve, "sync_index long, object_id long, keypoint_id long, n_views long, x_coord double, y_coord double, z_coord double")
    times = points.groupBy("sync_index").agg(F.avg("frame_time").alias("frame_time"))
    found = found.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("x_coord", "y_coord", "z_coord")})
    return found.join(times, "sync_index", "left").select(*WORLD_KEY, "x_coord", "y_coord", "z_coord", "frame_time", "n_views")


def project(world: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every world point in every posed camera: (keys, cam_id, img_loc_x, img_loc_y, depth)."""
    rows = G.with_pixels(world.crossJoin(F.broadcast(posed(cameras))))
    return rows.select("sync_index", "cam_id", *POINT, F.col("_u").alias("img_loc_x"), F.col("_v").alias("img_loc_y"), F.col("_depth").alias("depth"), "width", "height")


def visible(projected: DataFrame) -> DataFrame:
    """In front of the camera and within the image.

    Each pixel stands once in the condition: Spark moves it below the projection and so
    writes the whole lens model out wherever a pixel stands.
    """
    return projected.filter("depth > 0 and floor(img_loc_x / width) = 0 and floor(img_loc_y / height) = 0")


def facing(centre: tuple, normal: tuple) -> F.Column:
    """Whether a camera looks at the front of a face: the normal points towards its centre."""
    at = G.camera_centre()
    return sum(((c - F.lit(p)) * F.lit(n) for c, p, n in zip(at, centre, normal)), F.lit(0.0)) > 0


def matched(points: DataFrame, world: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """Observations with their world point, null where there is none; static objects stand at one index.

    Repeated world points are one: that with the largest coordinates.
    """
    static = list(static_objects)
    at = F.when(F.col("object_id").isin(static), F.lit(STATIC_SYNC_INDEX).cast("long")).otherwise(F.col("sync_index"))
    one = world.groupBy(*WORLD_KEY).agg(F.max(F.struct("x_coord", "y_coord", "z_coord")).alias("_w"))
    one = one.select(F.col("sync_index").alias("_sync"), *POINT, "_w.*")
    return points.withColumn("_sync", at).join(one, ["_sync", *POINT], "left").select(*points.columns, "x_coord", "y_coord", "z_coord")


def residuals(points: DataFrame, world: DataFrame, cameras: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """(keys, error_x, error_y, euclidean_error): projected less observed, of matched rows of posed cameras."""
    rows = G.with_pixels(with_camera(matched(points, world, static_objects).filter("x_coord is not null"), cameras))
    out = rows.select(*IMAGE_KEY, (F.col("_u") - F.col("img_loc_x")).alias("error_x"), (F.col("_v") - F.col("img_loc_y")).alias("error_y"))
    return out.withColumn("euclidean_error", F.hypot("error_x", "error_y"))


def reprojection_summary(errors: DataFrame) -> DataFrame:
    """(facet, cam_id, object_id, keypoint_id, n, rmse): overall, by camera and by point in one pass."""
    rmse = F.sqrt(F.avg(F.col("euclidean_error") * F.col("euclidean_error")))
    sets = errors.groupingSets([[], ["cam_id"], ["object_id", "keypoint_id"]], "cam_id", "object_id", "keypoint_id")
    level = F.grouping_id("cam_id", "object_id", "keypoint_id")
    out = sets.agg(level.alias("_level"), F.count("*").alias("n"), rmse.alias("rmse"))
    facet = F.when(F.col("_level") == 7, "overall").when(F.col("_level") == 3, "camera").otherwise("point")
    return out.select(facet.alias("facet"), "cam_id", *POINT, "n", "rmse")


def camera_errors(errors: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, n, rmse) of each posed camera; 0 without rows."""
    each = errors.groupBy("cam_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("euclidean_error") ** 2)).alias("rmse"))
    return posed(cameras).select("cam_id").join(each, "cam_id", "left").select("cam_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rmse", F.lit(0.0)).alias("rmse"))


def unmatched(points: DataFrame, world: DataFrame, cameras: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """(cam_id, n_total, n_unmatched, rate) for all cameras: rows without a world point or of cameras without a pose."""
    flagged = matched(points, world, static_objects).join(F.broadcast(posed(cameras).select("cam_id", F.lit(True).alias("_posed"))), "cam_id", "left")
    good = F.col("x_coord").isNotNull() & F.coalesce("_posed", F.lit(False))
    each = flagged.groupBy("cam_id").agg(F.count("*").alias("n_total"), F.count_if(~good).alias("n_unmatched"))
    out = cameras.select("cam_id").join(each, "cam_id", "left").select("cam_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_total", "n_unmatched")))
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("n_unmatched"), F.col("n_total")), F.lit(0.0)))


def error_percentiles(errors: DataFrame, at: tuple[float, ...] = (0.5, 0.95, 0.975, 0.99)) -> DataFrame:
    """(percentile, error), exact and interpolated."""
    return quantiles(errors, "euclidean_error", at).select("percentile", F.col("euclidean_error").alias("error"))


def percent_above(errors: DataFrame, limit: float) -> DataFrame:
    return errors.agg((F.avg((F.col("euclidean_error") > limit).cast("double")) * 100).alias("percent_above"))


def _with_floor(errors: DataFrame, keep: F.Column, least: int) -> DataFrame:
    """Rows to keep, and for cameras left with fewer than ``least`` their smallest errors, ties included.

    The limit of a camera is found from its counts by error and not by ranking its rows: of
    groups of its errors, the least ones only are ranked together. ``errors`` is read several times.
    """
    flagged = errors.withColumn("_keep", keep)
    kept = flagged.groupBy("cam_id").agg(F.count_if("_keep").alias("_kept"))
    short = kept.filter(F.col("_kept") < least).select("cam_id")
    by_error = flagged.join(F.broadcast(short), "cam_id").groupBy("cam_id", "euclidean_error").agg(F.count("*").alias("_n"))
    group = F.pmod(F.xxhash64("euclidean_error"), F.lit(64))
    first = by_error.withColumn("_place", F.row_number().over(Window.partitionBy("cam_id", group).orderBy("euclidean_error"))).filter(F.col("_place") <= least)
    w = Window.partitionBy("cam_id").orderBy("euclidean_error").rowsBetween(Window.unboundedPreceding, -1)
    limit = first.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter(F.col("_before") < least).groupBy("cam_id").agg(F.max("euclidean_error").alias("_limit"))
    out = flagged.join(F.broadcast(limit), "cam_id", "left")
    return out.filter(F.col("_keep") | (F.col("euclidean_error") <= F.col("_limit"))).select(*errors.columns)


def _written(errors: DataFrame) -> DataFrame:
    """``errors``, computed once."""
    use_checkpoints(errors.sparkSession)
    return errors.checkpoint()


def within_pixels(errors: DataFrame, limit: float, least: int = 10) -> DataFrame:
    """Residuals of at most ``limit`` pixels, with the floor for each camera."""
    if limit <= 0 or least < 1:
        raise ValueError("the limit and the floor must be positive")
    errors = _written(errors)
    return _with_floor(errors, F.col("euclidean_error") <= limit, least)


def without_worst(errors: DataFrame, percent: float, by_camera: bool = True, least: int = 10) -> DataFrame:
    """Without the worst ``percent`` of residuals, of each camera or overall, with the floor."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be within (0, 100]")
    errors = _written(errors)
    q = quantiles(errors, "euclidean_error", (1 - percent / 100,), ("cam_id",) if by_camera else (), written=True).drop("percentile").withColumnRenamed("euclidean_error", "_q")
    rows = errors.join(F.broadcast(q), "cam_id") if by_camera else errors.crossJoin(F.broadcast(q))
    return _with_floor(rows, F.col("euclidean_error") <= F.col("_q"), least).select(*errors.columns)


def apply_filter(points: DataFrame, world: DataFrame, kept: DataFrame, static_objects: Iterable[int] = ()) -> tuple[DataFrame, DataFrame]:
    """Observations and world points that kept residuals leave; static points stay while any row of them does."""
    images = points.join(kept.select(*IMAGE_KEY).distinct(), list(IMAGE_KEY), "left_semi").select(*points.columns)
    seen = collapse_static(images, static_objects).select(*WORLD_KEY).distinct()
    return images, world.join(seen, list(WORLD_KEY), "left_semi").select(*world.columns)
