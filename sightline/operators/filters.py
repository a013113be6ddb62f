"""Filters over observations and points: each takes a relation and returns one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.places import numbered
from sightline.schema import IMAGE_KEY, POINT, STATIC_SYNC_INDEX, WORLD_KEY

MODULUS = 1_000_003


def key_hash(seed: int, *columns: str) -> Column:
    """A number under MODULUS that depends on keys and seed alone, however rows are partitioned."""
    mixed = F.lit(seed)
    for c in columns:
        mixed = (mixed * F.lit(31_337) + F.col(c) * F.lit(7_919) + F.lit(104_729)) % F.lit(MODULUS)
    return (mixed * F.lit(48_271)) % F.lit(MODULUS)


def filter_to_objects(points: DataFrame, ids: Iterable[int]) -> DataFrame:
    return points.filter(F.col("object_id").isin(list(ids)))


def dropped_objects(points: DataFrame, ids: Iterable[int]) -> DataFrame:
    """(object_id, n_dropped) of what ``filter_to_objects`` leaves out."""
    return points.filter(~F.col("object_id").isin(list(ids))).groupBy("object_id").agg(F.count("*").alias("n_dropped"))


def posed(cameras: DataFrame) -> DataFrame:
    """Cameras with a pose that are not ignored."""
    return cameras.filter("r0 is not null and t0 is not null and not coalesce(ignored, false)")


def posed_observations(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations of posed cameras. A rig has tens of cameras, which Spark sends to each task."""
    return points.join(F.broadcast(posed(cameras).select("cam_id")), "cam_id", "left_semi").select(*points.columns)


def collapse_static(points: DataFrame, static_objects: Iterable[int]) -> DataFrame:
    """Rows of static objects move to the static sync index, all others stay."""
    static = F.col("object_id").isin(list(static_objects))
    return points.withColumn("sync_index", F.when(static, F.lit(STATIC_SYNC_INDEX).cast("long")).otherwise(F.col("sync_index")))


def drop_static(points: DataFrame) -> DataFrame:
    return points.filter(F.col("sync_index") != STATIC_SYNC_INDEX)


def drop_cameras(points: DataFrame, cam_ids: Iterable[int]) -> DataFrame:
    return points.filter(~F.col("cam_id").isin(list(cam_ids)))


def drop_frame_ranges(points: DataFrame, ranges: Iterable[tuple[int, int]]) -> DataFrame:
    """Without the frames of ranges whose both ends count."""
    for first, last in ranges:
        points = points.filter(~F.col("sync_index").between(first, last))
    return points


def kill_linkage(points: DataFrame, a: int, b: int) -> DataFrame:
    """Rows of cameras a and b go where both see the point; one window, no self-join."""
    w = Window.partitionBy(*WORLD_KEY)
    both = (F.max((F.col("cam_id") == a).cast("int")).over(w) == 1) & (F.max((F.col("cam_id") == b).cast("int")).over(w) == 1)
    return points.withColumn("_both", both).filter(~(F.col("_both") & F.col("cam_id").isin(a, b))).drop("_both")


def occlude(points: DataFrame, cam_id: int, fraction: float, targets: Iterable[int] | None = None, seed: int = 42) -> DataFrame:
    """A camera loses a fraction of the points that it shares with any target camera (all
    others by default), chosen by a hash of their keys."""
    own = points.filter(F.col("cam_id") == cam_id).select(*WORLD_KEY).distinct()
    seen_by = points.filter(F.col("cam_id") != cam_id if targets is None else F.col("cam_id").isin(list(targets)))
    shared = own.join(seen_by.select(*WORLD_KEY).distinct(), list(WORLD_KEY), "left_semi")
    ranked = top_fraction(shared, fraction, key_hash(seed, *WORLD_KEY), WORLD_KEY)
    lost = ranked.select(*WORLD_KEY, F.lit(cam_id).cast("long").alias("cam_id"))
    return points.join(lost, list(IMAGE_KEY), "left_anti").select(*points.columns)


def top_fraction(rows: DataFrame, fraction: float, score: Column, ties: tuple[str, ...], rounded: bool = False) -> DataFrame:
    """The part of the rows with the smallest score, exactly ``int`` (or ``round``) of n times fraction.

    The score's distribution is summed up first (at most MODULUS values), so that rows are
    ranked only within the one score where the cut falls.
    """
    scored = rows.withColumn("_score", score)
    counts = scored.groupBy("_score").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(F.sum("_n").alias("_total"))
    room = F.bround(F.col("_total") * fraction) if rounded else F.floor(F.col("_total") * fraction)
    before = counts.select("_score", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before")).crossJoin(F.broadcast(total)).select("_score", (room - F.col("_before")).alias("_room"))
    inside = scored.join(before.filter("_room > 0"), "_score")
    nth = F.row_number().over(Window.partitionBy("_score").orderBy(*ties))
    return inside.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_room")).drop("_score", "_nth", "_room")


def random_dropout(points: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Each row goes with the given chance, decided by a hash of its key."""
    return points.filter(key_hash(seed, *IMAGE_KEY) >= F.lit(fraction * MODULUS))


@dataclass(frozen=True)
class FilterConfig:
    """Reductions in a fixed order: cameras, linkages, occlusions, frame ranges, dropout."""

    cameras: tuple[int, ...] = ()
    linkages: tuple[tuple[int, int], ...] = ()
    occlusions: tuple[tuple[int, float, tuple[int, ...] | None], ...] = ()
    frame_ranges: tuple[tuple[int, int], ...] = ()
    dropout: float = 0.0
    seed: int = field(default=42)

    def with_linkage(self, a: int, b: int) -> FilterConfig:
        pair = (min(a, b), max(a, b))
        return self if pair in self.linkages else replace(self, linkages=(*self.linkages, pair))

    def without_linkage(self, a: int, b: int) -> FilterConfig:
        return replace(self, linkages=tuple(p for p in self.linkages if p != (min(a, b), max(a, b))))

    def apply(self, points: DataFrame) -> DataFrame:
        out = drop_cameras(points, self.cameras) if self.cameras else points
        for a, b in self.linkages:
            out = kill_linkage(out, a, b)
        for cam, fraction, targets in self.occlusions:
            out = occlude(out, cam, fraction, targets, self.seed)
        out = drop_frame_ranges(out, self.frame_ranges)
        return random_dropout(out, self.dropout, self.seed) if self.dropout else out


def remap_points(points: DataFrame, remaps: DataFrame) -> DataFrame:
    """Observations of a remapped point take the identity and place of its target.

    ``remaps``: object_id_from, keypoint_id_from, object_id_to, keypoint_id_to, obj_loc_x/y/z;
    a source must have one rule, and a target must not be the source of another one (ValueError).
    """
    sources = remaps.select(F.col("object_id_from").alias("o"), F.col("keypoint_id_from").alias("k"))
    targets = remaps.select(F.col("object_id_to").alias("o"), F.col("keypoint_id_to").alias("k"))
    if not sources.groupBy("o", "k").count().filter("count > 1").isEmpty():
        raise ValueError("a point has two rules")
    if not targets.join(sources, ["o", "k"], "left_semi").isEmpty():
        raise ValueError("the target of a rule is the source of another one")
    r = remaps.select(F.col("object_id_from").alias("object_id"), F.col("keypoint_id_from").alias("keypoint_id"), "object_id_to", "keypoint_id_to", *(F.col(f"obj_loc_{a}").alias(f"_{a}") for a in "xyz"))
    hit = F.col("object_id_to").isNotNull()
    return points.join(r, list(POINT), "left").select(*(
        F.coalesce(f"{c}_to", c).alias(c) if c in POINT
        else F.when(hit, F.col(f"_{c[-1]}")).otherwise(F.col(c)).alias(c) if c in ("obj_loc_x", "obj_loc_y", "obj_loc_z")
        else F.col(c)
        for c in points.columns
    ))


def inject_outliers(points: DataFrame, fraction: float, radius: float, seed: int = 42) -> DataFrame:
    """``round(fraction * n)`` rows move by up to ``radius`` pixels; a column says which."""
    chosen = top_fraction(points.select(*IMAGE_KEY).distinct(), fraction, key_hash(seed, *IMAGE_KEY), IMAGE_KEY, rounded=True)
    marked = points.join(chosen.withColumn("_hit", F.lit(True)), list(IMAGE_KEY), "left")
    hit = F.coalesce("_hit", F.lit(False))
    angle = key_hash(seed + 1, *IMAGE_KEY) / MODULUS * 6.283185307179586
    far = (0.5 + 0.5 * key_hash(seed + 2, *IMAGE_KEY) / MODULUS) * radius
    moved = marked.withColumns({
        "img_loc_x": F.when(hit, F.col("img_loc_x") + far * F.cos(angle)).otherwise(F.col("img_loc_x")),
        "img_loc_y": F.when(hit, F.col("img_loc_y") + far * F.sin(angle)).otherwise(F.col("img_loc_y")),
        "is_outlier": hit,
    })
    return moved.select(*points.columns, "is_outlier")


def frames_with_corners(points: DataFrame, least: int) -> DataFrame:
    """(cam_id, sync_index, n_corners) of frames with enough rows."""
    return points.groupBy("cam_id", "sync_index").agg(F.count("*").alias("n_corners")).filter(F.col("n_corners") >= least)


def every_nth_frame(points: DataFrame, step: int) -> DataFrame:
    """Rows of every nth distinct frame, by its place in order."""
    nth = numbered(points.select("sync_index").distinct(), "sync_index", name="_nth").filter(F.col("_nth") % step == 0)
    return points.join(nth, "sync_index", "left_semi").select(*points.columns)


def confident(points: DataFrame, threshold: float) -> DataFrame:
    return points.filter(F.col("confidence") >= threshold)


def exclude_points(points: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the object ids listed."""
    return points.join(excluded.select("object_id").distinct(), "object_id", "left_anti").select(*points.columns)
