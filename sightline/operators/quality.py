"""Scale, rigidity and geometry reports, and what calibrations are anchored to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.functions.scalars import grid_cell, tilt_bin
from sightline.operators.filters import collapse_static, drop_static, posed
from sightline.operators.quantiles import quantiles
from sightline.schema import POINT, STATIC_SYNC_INDEX


def object_frames(points: DataFrame, world: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """(sync_index, object_id, keypoint_id, X.., O.., n_cameras): world points beside their place in the object.

    The place is that of the lowest camera; z is 0 where an object has none in a frame.
    """
    static = F.col("object_id").isin(list(static_objects))
    known = points.filter("obj_loc_x is not null and obj_loc_y is not null")
    place = known.groupBy("sync_index", *POINT).agg(F.min_by(F.struct("obj_loc_x", "obj_loc_y", "obj_loc_z"), "cam_id").alias("o"), F.collect_set("cam_id").alias("cams"))
    place = place.withColumn("_z", F.count("o.obj_loc_z").over(Window.partitionBy("sync_index", "object_id")))
    place = place.withColumn("_sync", F.when(static, F.lit(STATIC_SYNC_INDEX).cast("long")).otherwise(F.col("sync_index")))
    w = world.select(F.col("sync_index").alias("_sync"), *POINT, "x_coord", "y_coord", "z_coord")
    return place.join(w, ["_sync", *POINT]).select(
        "sync_index", *POINT, "x_coord", "y_coord", "z_coord", F.col("o.obj_loc_x").alias("ox"), F.col("o.obj_loc_y").alias("oy"),
        F.when(F.col("_z") == 0, 0.0).otherwise(F.col("o.obj_loc_z")).alias("oz"), "cams",
    ).filter("oz is not null")


def scale_frame_errors(points: DataFrame, world: DataFrame, static_objects: Iterable[int] = (), least: int = 3) -> DataFrame:
    """For each object and frame: all distances between its points against those of the object.

    The points of a frame's object are as many as the object has; they are paired within
    one row, and no join is needed.
    """
    rows = object_frames(points, world, static_objects)
    p = F.struct("keypoint_id", "x_coord", "y_coord", "z_coord", "ox", "oy", "oz")
    frames = rows.groupBy("sync_index", "object_id").agg(
        F.array_sort(F.collect_list(p)).alias("p"), F.count("*").alias("n_corners"), F.size(F.array_distinct(F.flatten(F.collect_list("cams")))).alias("n_cameras"),
        F.avg("x_coord").alias("centroid_x"), F.avg("y_coord").alias("centroid_y"), F.avg("z_coord").alias("centroid_z"),
    ).filter(F.col("n_corners") >= least)
    pairs = frames.select("*", F.posexplode("p").alias("i", "a")).select("*", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("b"))
    dist = lambda cols: F.sqrt(sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in cols), F.lit(0.0)))
    measured, true = dist(("x_coord", "y_coord", "z_coord")), dist(("ox", "oy", "oz"))
    err = pairs.withColumn("e", measured - true).withColumn("d", true)
    keys = ("sync_index", "object_id", "n_corners", "n_cameras", "centroid_x", "centroid_y", "centroid_z")
    return err.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg("e").alias("mean_error"), F.max(F.abs("e")).alias("max_error"),
        F.sum(F.col("e") ** 2).alias("sse"), F.try_divide(F.sum(F.col("e") ** 2), F.max("d") ** 2).alias("relative_sse"),
    )


def scale_report(frames: DataFrame) -> DataFrame:
    """One row: pooled rmse in mm and percent, bias, median, max, worst frame."""
    return frames.agg(
        F.count("*").alias("n_frames"), (F.sqrt(F.try_divide(F.sum("sse"), F.sum("n_pairs"))) * 1000).alias("pooled_rmse_mm"),
        (F.sqrt(F.try_divide(F.sum("relative_sse"), F.sum("n_pairs"))) * 100).alias("pooled_relative_pct"),
        (F.try_divide(F.sum(F.col("mean_error") * F.col("n_pairs")), F.sum("n_pairs")) * 1000).alias("bias_mm"),
        (F.median("rmse") * 1000).alias("median_rmse_mm"), (F.max("rmse") * 1000).alias("max_rmse_mm"),
        F.max_by("sync_index", F.struct("rmse", -F.col("sync_index"))).alias("worst_sync_index"),
    )


def pooled_by_object(frames: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """(side, object_id, rmse_mm): pooled by object and by moving or static, in one pass; null without pairs."""
    side = frames.withColumn("side", F.when(F.col("object_id").isin(list(static_objects)), "static").otherwise("moving"))
    sets = side.groupingSets([["side"], ["side", "object_id"]], "side", "object_id")
    return sets.agg((F.sqrt(F.try_divide(F.sum("sse"), F.sum("n_pairs"))) * 1000).alias("rmse_mm"))


def depth_ratios(world: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, n, depth_ratio): 95th over 5th percentile of depths in front of each posed camera; null under two."""
    rows = drop_static(world).crossJoin(F.broadcast(posed(cameras)))
    depth = rows.select("cam_id", G.camera_frame(F.col("x_coord"), F.col("y_coord"), F.col("z_coord"))[2].alias("z")).filter("z > 0")
    each = depth.groupBy("cam_id").agg(F.count("*").alias("n"))
    q = quantiles(depth, "z", (0.05, 0.95), ("cam_id",)).groupBy("cam_id").agg(F.min_by("z", "percentile").alias("near"), F.max_by("z", "percentile").alias("far"))
    out = posed(cameras).select("cam_id").join(each, "cam_id", "left").join(q, "cam_id", "left")
    return out.select("cam_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 2, F.try_divide("far", "near")).alias("depth_ratio"))


def rigidity_violations(world: DataFrame, distances: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """Distance constraints where both ends stand: at the same frame, or both at the static index.

    ``distances``: constraint_id, object_id_a, keypoint_id_a, object_id_b, keypoint_id_b,
    distance, sigma. Constraints are configuration and go to every task.
    """
    static = list(static_objects)
    c = distances.filter(F.col("object_id_a").isin(static) == F.col("object_id_b").isin(static))
    points = world.filter(F.col("object_id").isin(static) == (F.col("sync_index") == STATIC_SYNC_INDEX))
    ends = c.select("constraint_id", "object_id_a", "object_id_b", "distance", "sigma", F.inline(F.array(
        F.struct(F.lit("a").alias("end"), F.col("object_id_a").alias("object_id"), F.col("keypoint_id_a").alias("keypoint_id")),
        F.struct(F.lit("b").alias("end"), F.col("object_id_b").alias("object_id"), F.col("keypoint_id_b").alias("keypoint_id")),
    )))
    hit = points.join(ends, list(POINT))
    at = lambda e, v: F.max(F.when(F.col("end") == e, F.col(v)))
    both = hit.groupBy("constraint_id", "sync_index", "object_id_a", "object_id_b", "distance", "sigma").agg(
        F.count("*").alias("n"), *(at(e, f"{v}_coord").alias(f"{v}{e}") for e in "ab" for v in "xyz")
    ).filter("n = 2")
    measured = F.sqrt(sum(((F.col(f"{v}a") - F.col(f"{v}b")) ** 2 for v in "xyz"), F.lit(0.0)))
    return both.select("constraint_id", "sync_index", "object_id_a", "object_id_b", F.lit("corner").alias("kind"), "distance", "sigma", measured.alias("measured"), (measured - F.col("distance")).alias("violation"))


def centroid_violations(world: DataFrame, centroids: DataFrame, corners: int = 4) -> DataFrame:
    """Distances between the centres of two objects, at frames where all corners of both stand."""
    centres = world.filter(F.col("keypoint_id") < corners).groupBy("sync_index", "object_id").agg(F.count("*").alias("n"), *(F.avg(f"{v}_coord").alias(v) for v in "xyz")).filter(F.col("n") == corners)
    ends = centroids.select("constraint_id", "object_id_a", "object_id_b", "distance", "sigma", F.inline(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"object_id_{e}").alias("object_id")) for e in "ab"))))
    at = lambda e, v: F.max(F.when(F.col("end") == e, F.col(v)))
    both = centres.join(ends, "object_id").groupBy("constraint_id", "sync_index", "object_id_a", "object_id_b", "distance", "sigma").agg(F.count("*").alias("m"), *(at(e, v).alias(f"{v}{e}") for e in "ab" for v in "xyz")).filter("m = 2")
    measured = F.sqrt(sum(((F.col(f"{v}a") - F.col(f"{v}b")) ** 2 for v in "xyz"), F.lit(0.0)))
    return both.select("constraint_id", "sync_index", "object_id_a", "object_id_b", F.lit("centroid").alias("kind"), "distance", "sigma", measured.alias("measured"), (measured - F.col("distance")).alias("violation"))


def rigidity_report(violations: DataFrame) -> DataFrame:
    """(object_id, n, rmse_mm, max_mm, relative_rmse_pct): overall (null id) and of each object, counted for both ends once."""
    both = violations.withColumn("object_id", F.explode(F.array_distinct(F.array("object_id_a", "object_id_b"))))
    one = lambda d, key: d.groupBy(*key).agg(
        F.count("*").alias("n"), (F.sqrt(F.avg(F.col("violation") ** 2)) * 1000).alias("rmse_mm"), (F.max(F.abs("violation")) * 1000).alias("max_mm"),
        (F.sqrt(F.avg(F.try_divide(F.col("violation"), F.col("distance")) ** 2)) * 100).alias("relative_rmse_pct"),
    )
    overall = one(violations, []).select(F.lit(None).cast("long").alias("object_id"), "n", "rmse_mm", "max_mm", "relative_rmse_pct")
    return overall.unionByName(one(both, ["object_id"]))


def moving_static_markers(violations: DataFrame, share: float = 0.25) -> DataFrame:
    """(object_id): objects called static whose own distances are off by over a quarter of the largest."""
    own = violations.filter("object_id_a = object_id_b").groupBy(F.col("object_id_a").alias("object_id"))
    return own.agg(F.sqrt(F.avg(F.col("violation") ** 2)).alias("rmse"), F.max("distance").alias("largest")).filter(F.col("rmse") > share * F.col("largest")).select("object_id", "rmse", "largest")


def firing_constraints(violations: DataFrame) -> DataFrame:
    """(constraint_id, n_frames) of constraints that stand anywhere."""
    return violations.groupBy("constraint_id").agg(F.countDistinct("sync_index").alias("n_frames"))


def segment_lengths(world: DataFrame, a: int, b: int) -> DataFrame:
    """(object_id, n, median_length) between two keypoints of the same object and frame; no join."""
    at = lambda k, v: F.max(F.when(F.col("keypoint_id") == k, F.col(f"{v}_coord")))
    rows = world.filter(F.col("keypoint_id").isin(a, b)).groupBy("sync_index", "object_id").agg(F.countDistinct("keypoint_id").alias("n"), *(at(k, v).alias(f"{v}{i}") for i, k in enumerate((a, b)) for v in "xyz")).filter("n = 2")
    length = F.sqrt(sum(((F.col(f"{v}0") - F.col(f"{v}1")) ** 2 for v in "xyz"), F.lit(0.0)))
    return rows.groupBy("object_id").agg(F.count("*").alias("n"), F.median(length).alias("median_length"))


def depth_cues(cues: DataFrame, world: DataFrame) -> DataFrame:
    """(cue_id, reason, x, y, z): each cue's single point, or why there is none (missing, ambiguous)."""
    found = world.join(cues.select("cue_id", "sync_index", "keypoint_id"), ["sync_index", "keypoint_id"])
    each = found.groupBy("cue_id").agg(F.count("*").alias("n"), F.min(F.struct("x_coord", "y_coord", "z_coord")).alias("p"))
    out = cues.select("cue_id").join(each, "cue_id", "left")
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("ok")
    p = lambda c: F.when(F.col("n") == 1, F.col(f"p.{c}")).alias(c)
    return out.select("cue_id", reason.alias("reason"), p("x_coord"), p("y_coord"), p("z_coord"))


def scale_factor(cues: DataFrame) -> DataFrame:
    """(scale, n): weighted least squares over measured and true lengths; exact for one cue."""
    w = 1 / (F.col("sigma") ** 2)
    return cues.agg(F.try_divide(F.sum(F.col("measured") * F.col("true_length") * w), F.sum(F.col("measured") ** 2 * w)).alias("scale"), F.count("*").alias("n"))


def disagreeing_cues(cues: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """(cue_a, cue_b) whose scales are more than two joint deviations apart; cues are a handful."""
    s = cues.select("cue_id", (F.col("true_length") / F.col("measured")).alias("s"), (F.col("sigma") / F.col("measured")).alias("d"))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{k}") for c in s.columns)) for k in "ab")
    pairs = F.broadcast(a).join(b, F.col("cue_id_a") < F.col("cue_id_b"))
    return pairs.filter(F.abs(F.col("s_a") - F.col("s_b")) > sigmas * F.hypot("d_a", "d_b")).select(F.col("cue_id_a").alias("cue_a"), F.col("cue_id_b").alias("cue_b"))


def floor_height(world: DataFrame, share: float = 0.01) -> DataFrame:
    """(floor): the z at place floor(share (n - 1)) in order.

    Counts by rounded z locate the slice in which it lies; only that slice is ranked.
    """
    slices = world.groupBy(F.floor(F.col("z_coord") * 1000).alias("s")).agg(F.count("*").alias("n"))
    before = slices.withColumn("b", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = before.crossJoin(F.broadcast(slices.agg(F.floor((F.sum("n") - 1) * share).alias("k")))).filter("b <= k and k < b + n").select("s", (F.col("k") - F.col("b") + 1).alias("nth"))
    own = world.select("z_coord", F.floor(F.col("z_coord") * 1000).alias("s")).join(F.broadcast(place), "s")
    return own.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("z_coord"))).filter("i = nth").select(F.col("z_coord").alias("floor"))


def camera_centroid(cameras: DataFrame) -> DataFrame:
    x, y, z = G.camera_centre()
    return posed(cameras).agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.avg(z).alias("z"))


def consensus_up(ups: DataFrame) -> DataFrame:
    """One row: the normalised mean of unit vectors, and the median and largest angle to it in degrees."""
    mean = ups.agg(*(F.avg(c).alias(f"m{c}") for c in ("x", "y", "z")))
    mean = mean.withColumn("_n", F.sqrt(sum((F.col(f"m{c}") ** 2 for c in "xyz"), F.lit(0.0)))).select(*((F.col(f"m{c}") / F.col("_n")).alias(f"up_{c}") for c in "xyz"))
    dot = sum((F.col(c) * F.col(f"up_{c}") for c in "xyz"), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    return ups.crossJoin(F.broadcast(mean)).groupBy("up_x", "up_y", "up_z").agg(F.median(angle).alias("median_angle"), F.max(angle).alias("max_angle"))


def focal_scale(cameras: DataFrame, pixels: float = 1.0) -> DataFrame:
    return cameras.filter("fx is not null").agg((F.lit(pixels) / F.median("fx")).alias("f_scale"))


def grid_coverage(points: DataFrame, cameras: DataFrame, cells: int = 5) -> DataFrame:
    """(cam_id, sync_index, n_cells): grid cells with a corner."""
    rows = points.join(F.broadcast(cameras.select("cam_id", "width", "height")), "cam_id")
    cell = grid_cell(F.col("img_loc_x"), F.col("width"), cells) * cells + grid_cell(F.col("img_loc_y"), F.col("height"), cells)
    return rows.groupBy("cam_id", "sync_index").agg(F.size(F.collect_set(cell)).cast("long").alias("n_cells"))


def grid_histogram(points: DataFrame, cameras: DataFrame, cells: int = 5) -> DataFrame:
    """(cam_id, col, row, n) over the whole grid, 0 where no corner lies."""
    rows = points.join(F.broadcast(cameras.select("cam_id", "width", "height")), "cam_id")
    counts = rows.groupBy("cam_id", grid_cell(F.col("img_loc_x"), F.col("width"), cells).alias("col"), grid_cell(F.col("img_loc_y"), F.col("height"), cells).alias("row")).agg(F.count("*").alias("n"))
    grid = points.select("cam_id").distinct().select("cam_id", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("col")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("row"))
    return grid.join(counts, ["cam_id", "col", "row"], "left").na.fill(0, ["n"])


def pose_features(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, sync_index, mean_x, mean_y, std_x, std_y, aspect) of corners in image units; aspect 1 for a flat spread."""
    rows = points.join(F.broadcast(cameras.select("cam_id", "width", "height")), "cam_id")
    x, y = F.col("img_loc_x") / F.col("width"), F.col("img_loc_y") / F.col("height")
    each = rows.groupBy("cam_id", "sync_index").agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.stddev_samp(x).alias("std_x"), F.stddev_samp(y).alias("std_y"))
    return each.withColumn("aspect", F.when(F.col("std_y") > 1e-6, F.col("std_x") / F.col("std_y")).otherwise(1.0))


def intrinsic_quality(points: DataFrame, cameras: DataFrame, cells: int = 5) -> DataFrame:
    """(cam_id, coverage, edge_coverage, corner_coverage, diversity): shares of cells with corners, and spread of frames."""
    rows = points.join(F.broadcast(cameras.select("cam_id", "width", "height")), "cam_id")
    col, row = grid_cell(F.col("img_loc_x"), F.col("width"), cells), grid_cell(F.col("img_loc_y"), F.col("height"), cells)
    hit = rows.select("cam_id", col.alias("c"), row.alias("r")).distinct()
    far = cells - 1
    edge = F.col("c").isin(0, far) | F.col("r").isin(0, far)
    corner = F.col("c").isin(0, far) & F.col("r").isin(0, far)
    share = hit.groupBy("cam_id").agg((F.count("*") / (cells * cells)).alias("coverage"), (F.count_if(edge) / (4 * cells - 4)).alias("edge_coverage"), (F.count_if(corner) / 4).alias("corner_coverage"))
    f = pose_features(points, cameras)
    spread = f.groupBy("cam_id").agg(((F.var_pop("mean_x") + F.var_pop("mean_y") + F.var_pop("aspect")) / 3).alias("diversity"))
    return share.join(spread, "cam_id")


def best_frames_by_tilt(tilts: DataFrame) -> DataFrame:
    """(cam_id, bin, sync_index, magnitude): the most tilted frame of each direction, the earliest of equals."""
    binned = tilts.withColumn("bin", tilt_bin(F.col("direction"), F.col("magnitude"))).filter("bin is not null")
    best = binned.groupBy("cam_id", "bin").agg(F.max(F.struct("magnitude", (-F.col("sync_index")).alias("s"))).alias("b"))
    return best.select("cam_id", "bin", (-F.col("b.s")).alias("sync_index"), F.col("b.magnitude").alias("magnitude"))


def capture_suitability(points: DataFrame, world: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, depth_ratio, x_span, y_span, peripheral): whether a capture constrains a lens."""
    rows = points.join(world.select("sync_index", *POINT, "x_coord", "y_coord", "z_coord"), ["sync_index", *POINT]).join(F.broadcast(posed(cameras)), "cam_id")
    z = G.camera_frame(F.col("x_coord"), F.col("y_coord"), F.col("z_coord"))[2]
    r = F.hypot(F.col("img_loc_x") - F.col("width") / 2, F.col("img_loc_y") - F.col("height") / 2)
    far = r > 0.6 * F.hypot(F.col("width") / 2, F.col("height") / 2)
    return rows.groupBy("cam_id").agg(
        F.try_divide(F.max(z), F.min(z)).alias("depth_ratio"), ((F.max("img_loc_x") - F.min("img_loc_x")) / F.first("width")).alias("x_span"),
        ((F.max("img_loc_y") - F.min("img_loc_y")) / F.first("height")).alias("y_span"), F.avg(far.cast("double")).alias("peripheral"),
    )


def wireframe(world: DataFrame, segments: DataFrame) -> DataFrame:
    """(sync_index, object_id, segment, ax.., bx..): segments both of whose points stand; no self-join."""
    ends = segments.select("segment", F.inline(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"keypoint_{e}").alias("keypoint_id")) for e in "ab"))))
    hit = world.join(ends, "keypoint_id")
    at = lambda e, v: F.max(F.when(F.col("end") == e, F.col(f"{v}_coord")))
    return hit.groupBy("sync_index", "object_id", "segment").agg(F.countDistinct("end").alias("n"), *(at(e, v).alias(f"{e}{v}") for e in "ab" for v in "xyz")).filter("n = 2").drop("n")


def camera_quality(points: DataFrame, errors: DataFrame, world: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, n_observed, n, rmse, depth_ratio) beside each other."""
    from sightline.operators.reconstruction import camera_errors

    seen = points.groupBy("cam_id").agg(F.count("*").alias("n_observed"))
    return camera_errors(errors, cameras).join(seen, "cam_id", "left").join(depth_ratios(world, cameras).select("cam_id", "depth_ratio"), "cam_id").select("cam_id", F.coalesce("n_observed", F.lit(0)).alias("n_observed"), "n", "rmse", "depth_ratio")


def marker_quality(frame_errors: DataFrame, errors: DataFrame, static_objects: Iterable[int] = ()) -> DataFrame:
    """(object_id, is_static, reprojection_rmse, relative_rmse_pct, rmse_mm, n_pairs) of each object with
    scale errors (those of scale_frame_errors), pooled over its frames; 0 px without residuals."""
    seen = errors.groupBy("object_id").agg(F.sqrt(F.avg(F.col("euclidean_error") ** 2)).alias("px"))
    pooled = lambda c: F.sqrt(F.try_divide(F.sum(c), F.sum("n_pairs")))
    scale = frame_errors.groupBy("object_id").agg((pooled("relative_sse") * 100).alias("relative_rmse_pct"), (pooled("sse") * 1000).alias("rmse_mm"), F.sum("n_pairs").alias("n_pairs"))
    out = scale.join(seen, "object_id", "left").withColumn("is_static", F.col("object_id").isin(list(static_objects)))
    return out.select("object_id", "is_static", F.coalesce("px", F.lit(0.0)).alias("reprojection_rmse"), "relative_rmse_pct", "rmse_mm", "n_pairs")


def static_world(points: DataFrame, static_objects: Iterable[int]) -> DataFrame:
    return collapse_static(points, static_objects)
