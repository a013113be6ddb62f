"""Which cameras see the same points, and what that means for linking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.scalars import link_quality
from sightline.schema import IMAGE_KEY, WORLD_KEY


def coverage_pairs(points: DataFrame) -> DataFrame:
    """(cam_a, cam_b, n): points seen by both, a <= b; of a camera with itself, points seen.

    The cameras of a point are gathered into one set (as many as the rig has), and pairs
    come from that, so that observations are shuffled once and never joined.
    """
    seen = points.groupBy(*WORLD_KEY).agg(F.array_sort(F.collect_set("cam_id")).alias("cams"))
    a = seen.select(F.posexplode("cams").alias("i", "cam_a"), "cams")
    b = a.select("cam_a", F.explode(F.expr("slice(cams, i + 1, size(cams))")).alias("cam_b"))
    return b.groupBy("cam_a", "cam_b").agg(F.count("*").alias("n"))


def coverage_matrix(points: DataFrame) -> DataFrame:
    """The same in both directions."""
    half = coverage_pairs(points)
    return half.unionByName(half.filter("cam_a <> cam_b").select(F.col("cam_b").alias("cam_a"), F.col("cam_a").alias("cam_b"), "n"))


def coverage_wide(points: DataFrame, cam_ids: list[int]) -> DataFrame:
    return coverage_matrix(points).groupBy("cam_a").pivot("cam_b", cam_ids).agg(F.first("n")).na.fill(0)


def camera_links(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, n_points, degree, n_links): every camera of the rig, with the others it shares points with."""
    m = coverage_matrix(points)
    each = m.groupBy(F.col("cam_a").alias("cam_id")).agg(
        F.coalesce(F.sum(F.when(F.col("cam_a") == F.col("cam_b"), F.col("n"))), F.lit(0)).alias("n_points"),
        F.count_if((F.col("cam_a") != F.col("cam_b")) & (F.col("n") > 0)).alias("degree"),
        F.coalesce(F.sum(F.when(F.col("cam_a") != F.col("cam_b"), F.col("n"))), F.lit(0)).alias("n_shared"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return F.broadcast(cameras.select("cam_id")).join(each, "cam_id", "left").select("cam_id", zero("n_points"), zero("degree"), zero("n_shared"))


def coverage_report(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """camera_links with is_isolated (no link) and is_leaf (one link)."""
    links = camera_links(points, cameras)
    return links.withColumns({"is_isolated": F.col("degree") == 0, "is_leaf": F.col("degree") == 1})


def link_report(points: DataFrame) -> DataFrame:
    pairs = coverage_pairs(points).filter("cam_a < cam_b")
    return pairs.withColumn("quality", link_quality(F.col("n")))


def camera_components(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_id, component): the smallest camera reachable over shared points.

    The camera graph is as small as the rig: its edges alone come to the driver.
    """
    spark = points.sparkSession
    m = coverage_matrix(points).filter("cam_a <> cam_b")
    ids = [r["cam_id"] for r in cameras.select("cam_id").collect()]  # one row for each camera
    label = {c: c for c in ids}

    def root(c: int) -> int:
        while label[c] != c:
            c = label[c]
        return c

    for r in m.filter("cam_a < cam_b").select("cam_a", "cam_b").collect():
        if r["cam_a"] in label and r["cam_b"] in label:
            a, b = sorted((root(r["cam_a"]), root(r["cam_b"])))
            label[b] = a
    return spark.createDataFrame([(c, root(c)) for c in ids], "cam_id long, component long")


def structural_warnings(points: DataFrame, cameras: DataFrame, leaf_points: int = 100) -> DataFrame:
    """(severity, ordinal, cam_id, message): critical first, then in camera order."""
    links = coverage_report(points, cameras)
    n_cameras = cameras.count()
    parts = camera_components(points, cameras).agg(F.countDistinct("component").alias("n"))
    isolated = links.filter("is_isolated").select(F.lit("critical").alias("severity"), F.lit(0).alias("ordinal"), "cam_id", F.lit("camera shares no points").alias("message"))
    split = parts.filter("n > 1").select(F.lit("critical").alias("severity"), F.lit(1).alias("ordinal"), F.lit(None).cast("long").alias("cam_id"), F.concat(F.lit("cameras form "), F.col("n").cast("string"), F.lit(" groups")).alias("message"))
    weak = links.filter((F.col("is_leaf")) & (F.col("n_shared") < leaf_points) & F.lit(n_cameras > 2)).select(F.lit("warning").alias("severity"), F.lit(2).alias("ordinal"), "cam_id", F.lit("camera hangs on one weak link").alias("message"))
    return isolated.unionByName(split).unionByName(weak).orderBy("ordinal", "cam_id")


def pair_correspondences(points: DataFrame, least: int = 4) -> DataFrame:
    """Rows of the same point in two cameras a < b, for pairs with enough of them.

    Points of one key are gathered by camera and paired within the key.
    """
    row = F.struct("cam_id", "img_loc_x", "img_loc_y")
    seen = points.filter("img_loc_x is not null and img_loc_y is not null").groupBy(*WORLD_KEY).agg(F.array_sort(F.collect_list(row)).alias("obs"))
    a = seen.select(*WORLD_KEY, F.explode("obs").alias("a"), "obs")
    b = a.select(*WORLD_KEY, "a", F.explode(F.expr("filter(obs, o -> o.cam_id > a.cam_id)")).alias("b"))
    rows = b.select(F.col("a.cam_id").alias("cam_a"), F.col("b.cam_id").alias("cam_b"), *WORLD_KEY, *(F.col(f"{s}.img_loc_{c}").alias(f"{c}_{s}") for s in "ab" for c in "xy"))
    enough = rows.groupBy("cam_a", "cam_b").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return rows.join(F.broadcast(enough.select("cam_a", "cam_b")), ["cam_a", "cam_b"], "left_semi")


def observed(points: DataFrame) -> DataFrame:
    return points.select(*IMAGE_KEY).distinct()
