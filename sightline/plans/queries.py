"""The library's queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import schema
from sightline.functions import geometry, scalars
from sightline.operators import bundle, calibrate, constraints, coverage, epipolar, filters, intrinsics, joint, playback, poses, quality, reconstruction, selection, targets, timing, trajectories
from sightline.sources import events, rig, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RIG = rig.ring(4)
#: The same rig with a fisheye camera.
ROUND_RIG = rig.ring(4, fisheye=(2,))
#: The same rig with a camera that is ignored and one more that has no pose and sees nothing.
PART_RIG = [*rig.ring(4, ignored=(3,)), rig.ring(5, unposed=(4,))[4]]


def query(sql: str | None = None):
    """Registers a function under its name; the SQL may use obs, world, cams, part_cams and round_cams."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            views = (("obs", events.OBSERVATIONS_SQL), ("world", events.WORLD_SQL), ("cams", rig.cameras_sql(RIG)), ("part_cams", rig.cameras_sql(PART_RIG)), ("round_cams", rig.cameras_sql(ROUND_RIG)))
            ORACLES[f.__name__] = ("WITH RECURSIVE " if sql.strip().startswith("AND RECURSIVE") else "WITH ") + ", ".join(f"{n} AS ({body})" for n, body in views) + (", " + sql.strip()[4:].lstrip().removeprefix("RECURSIVE ") if sql.strip().upper().startswith("AND ") else " " + sql.strip())
        return f

    return put


def obs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.observations(spark, sf_dir)


def cams_of(spark: SparkSession, part: bool = False) -> DataFrame:
    return rig.cameras(spark, PART_RIG if part else RIG)


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Doubles to a fixed number of digits, for comparing; adding zero makes -0 a 0."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


# --- relations and filters -------------------------------------------------------------------------

OBS_COLUMNS = "sync_index, cam_id, object_id, keypoint_id, img_loc_x, img_loc_y, frame_time"
R_OBS = "sync_index, cam_id, object_id, keypoint_id, round(img_loc_x, 6) + 0 AS img_loc_x, round(img_loc_y, 6) + 0 AS img_loc_y, round(frame_time, 6) + 0 AS frame_time"


def _obs_out(df: DataFrame) -> DataFrame:
    return rounded(df.select(*OBS_COLUMNS.split(", ")))


@query(f"SELECT {R_OBS} FROM obs")
def image_points(spark, sf_dir):
    return _obs_out(schema.coerce(obs_of(spark, sf_dir), schema.IMAGE_POINTS))


@query("SELECT sync_index, object_id, keypoint_id, round(x_coord, 6) + 0 AS x_coord, round(y_coord, 6) + 0 AS y_coord, round(z_coord, 6) + 0 AS z_coord FROM world")
def world_points(spark, sf_dir):
    return rounded(schema.coerce(events.world(obs_of(spark, sf_dir)), schema.WORLD_POINTS).drop("frame_time"))


@query("SELECT CAST(count(*) FILTER (WHERE sync_index IS NULL) AS BIGINT) AS sync_index, CAST(count(*) FILTER (WHERE img_loc_x IS NULL) AS BIGINT) AS img_loc_x FROM obs")
def null_counts(spark, sf_dir):
    return schema.null_counts(obs_of(spark, sf_dir), schema.IMAGE_POINTS).select("sync_index", "img_loc_x")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_keys(spark, sf_dir):
    return schema.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))


@query(f"SELECT {R_OBS} FROM obs WHERE object_id IN (1)")
def filter_objects(spark, sf_dir):
    return _obs_out(filters.filter_to_objects(obs_of(spark, sf_dir), [1]))


@query("SELECT object_id, count(*) AS n_dropped FROM obs WHERE object_id NOT IN (1) GROUP BY object_id")
def dropped_objects(spark, sf_dir):
    return filters.dropped_objects(obs_of(spark, sf_dir), [1])


@query(f"SELECT {R_OBS} FROM obs WHERE cam_id IN (SELECT cam_id FROM part_cams WHERE r0 IS NOT NULL AND NOT ignored)")
def posed_observations(spark, sf_dir):
    return _obs_out(filters.posed_observations(obs_of(spark, sf_dir), cams_of(spark, True)))


@query(f"SELECT {R_OBS.replace('sync_index,', 'CASE WHEN object_id = 1 THEN -1 ELSE sync_index END AS sync_index,', 1)} FROM obs")
def static_split(spark, sf_dir):
    return _obs_out(filters.collapse_static(obs_of(spark, sf_dir), [1]))


@query(f"SELECT {R_OBS} FROM obs WHERE object_id <> 1")
def without_static(spark, sf_dir):
    return _obs_out(filters.drop_static(filters.collapse_static(obs_of(spark, sf_dir), [1])))


@query(f"SELECT {R_OBS} FROM obs WHERE cam_id NOT IN (2)")
def drop_cameras(spark, sf_dir):
    return _obs_out(filters.drop_cameras(obs_of(spark, sf_dir), [2]))


@query(f"SELECT {R_OBS} FROM obs WHERE sync_index NOT BETWEEN 3 AND 5 AND sync_index NOT BETWEEN 10 AND 12")
def drop_frame_ranges(spark, sf_dir):
    return _obs_out(filters.drop_frame_ranges(obs_of(spark, sf_dir), [(3, 5), (10, 12)]))


@query(f"""AND both_see AS (SELECT sync_index AS s, object_id AS o, keypoint_id AS k FROM obs WHERE cam_id = 0
INTERSECT SELECT sync_index, object_id, keypoint_id FROM obs WHERE cam_id = 1)
SELECT {R_OBS} FROM obs WHERE NOT (cam_id IN (0, 1) AND EXISTS (SELECT 1 FROM both_see WHERE s = sync_index AND o = object_id AND k = keypoint_id))""")
def kill_linkage(spark, sf_dir):
    return _obs_out(filters.kill_linkage(obs_of(spark, sf_dir), 0, 1))


def _hash_sql(seed: int, columns: list[str]) -> str:
    mixed = str(seed)
    for c in columns:
        mixed = f"(({mixed}) * 31337 + {c} * 7919 + 104729) % 1000003"
    return f"(({mixed}) * 48271) % 1000003"


WORLD_KEY, IMAGE_KEY = ["sync_index", "object_id", "keypoint_id"], ["sync_index", "cam_id", "object_id", "keypoint_id"]


@query(f"""AND shared AS (SELECT DISTINCT a.sync_index, a.object_id, a.keypoint_id FROM obs a JOIN obs b USING (sync_index, object_id, keypoint_id) WHERE a.cam_id = 1 AND b.cam_id <> 1),
lost AS (SELECT * FROM shared QUALIFY row_number() OVER (ORDER BY {_hash_sql(42, WORLD_KEY)}, sync_index, object_id, keypoint_id) <= floor((SELECT count(*) FROM shared) * 0.4))
SELECT {R_OBS} FROM obs WHERE NOT (cam_id = 1 AND EXISTS (SELECT 1 FROM lost l WHERE l.sync_index = obs.sync_index AND l.object_id = obs.object_id AND l.keypoint_id = obs.keypoint_id))""")
def occlude_camera(spark, sf_dir):
    return _obs_out(filters.occlude(obs_of(spark, sf_dir), 1, 0.4))


@query(f"SELECT {R_OBS} FROM obs WHERE {_hash_sql(42, IMAGE_KEY)} >= 0.3 * 1000003")
def random_dropout(spark, sf_dir):
    return _obs_out(filters.random_dropout(obs_of(spark, sf_dir), 0.3))


@query(f"""AND kept AS (SELECT * FROM obs WHERE cam_id <> 3), both_see AS (SELECT sync_index AS s, object_id AS o, keypoint_id AS k FROM kept WHERE cam_id = 0
INTERSECT SELECT sync_index, object_id, keypoint_id FROM kept WHERE cam_id = 2)
SELECT {R_OBS} FROM kept WHERE NOT (cam_id IN (0, 2) AND EXISTS (SELECT 1 FROM both_see WHERE s = sync_index AND o = object_id AND k = keypoint_id))
AND sync_index NOT BETWEEN 0 AND 4 AND {_hash_sql(7, IMAGE_KEY)} >= 0.1 * 1000003""")
def filter_config(spark, sf_dir):
    config = filters.FilterConfig(cameras=(3,), frame_ranges=((0, 4),), dropout=0.1, seed=7).with_linkage(2, 0).with_linkage(0, 2)
    return _obs_out(config.apply(obs_of(spark, sf_dir)))


@query(f"""SELECT sync_index, cam_id, CASE WHEN object_id = 1 AND keypoint_id = 2 THEN 0 ELSE object_id END AS object_id,
CASE WHEN object_id = 1 AND keypoint_id = 2 THEN 3 ELSE keypoint_id END AS keypoint_id, round(CASE WHEN object_id = 1 AND keypoint_id = 2 THEN 0.25 ELSE obj_loc_x END, 6) + 0 AS obj_loc_x FROM obs""")
def remap_points(spark, sf_dir):
    rules = spark.createDataFrame([(1, 2, 0, 3, 0.25, 0.5, 0.0)], "object_id_from long, keypoint_id_from long, object_id_to long, keypoint_id_to long, obj_loc_x double, obj_loc_y double, obj_loc_z double")
    return rounded(filters.remap_points(obs_of(spark, sf_dir), rules).select("sync_index", "cam_id", "object_id", "keypoint_id", "obj_loc_x"))


@query(f"""AND hit AS (SELECT * FROM obs QUALIFY row_number() OVER (ORDER BY {_hash_sql(42, IMAGE_KEY)}, sync_index, cam_id, object_id, keypoint_id) <= round_even((SELECT count(*) FROM obs) * 0.05, 0))
SELECT sync_index, cam_id, object_id, keypoint_id, true AS is_outlier FROM hit""")
def inject_outliers(spark, sf_dir):
    return filters.inject_outliers(obs_of(spark, sf_dir), 0.05, 40.0).filter("is_outlier").select(*IMAGE_KEY, "is_outlier")


@query("SELECT cam_id, sync_index, count(*) AS n_corners FROM obs GROUP BY ALL HAVING count(*) >= 6")
def frames_with_corners(spark, sf_dir):
    return filters.frames_with_corners(obs_of(spark, sf_dir), 6).select("cam_id", "sync_index", "n_corners")


@query(f"SELECT {R_OBS} FROM obs WHERE sync_index IN (SELECT sync_index FROM (SELECT DISTINCT sync_index FROM obs) QUALIFY (row_number() OVER (ORDER BY sync_index) - 1) % 7 = 0)")
def every_nth_frame(spark, sf_dir):
    return _obs_out(filters.every_nth_frame(obs_of(spark, sf_dir), 7))


@query(f"SELECT {R_OBS} FROM obs WHERE CAST(sync_index % 10 AS DOUBLE) / 10 >= 0.4")
def confident_points(spark, sf_dir):
    return _obs_out(filters.confident(obs_of(spark, sf_dir).withColumn("confidence", (F.col("sync_index") % 10).cast("double") / 10), 0.4))


@query(f"SELECT {R_OBS} FROM obs WHERE object_id <> 0")
def exclude_points(spark, sf_dir):
    return _obs_out(filters.exclude_points(obs_of(spark, sf_dir), spark.createDataFrame([(0,)], "object_id long")))


# --- coverage --------------------------------------------------------------------------------------

PAIRS = "pairs AS (SELECT a.cam_id AS cam_a, b.cam_id AS cam_b, count(DISTINCT (a.sync_index, a.object_id, a.keypoint_id)) AS n FROM obs a JOIN obs b USING (sync_index, object_id, keypoint_id) GROUP BY 1, 2)"


@query(f"AND {PAIRS} SELECT cam_a, cam_b, n FROM pairs")
def coverage_matrix(spark, sf_dir):
    return coverage.coverage_matrix(obs_of(spark, sf_dir))


@query(f"AND {PAIRS} SELECT cam_a, " + ", ".join(f'CAST(coalesce(max(n) FILTER (WHERE cam_b = {c}), 0) AS BIGINT) AS "{c}"' for c in range(4)) + " FROM pairs GROUP BY cam_a")
def coverage_wide(spark, sf_dir):
    return coverage.coverage_wide(obs_of(spark, sf_dir), [0, 1, 2, 3])


@query(f"""AND {PAIRS} SELECT c.cam_id, CAST(coalesce(sum(n) FILTER (WHERE cam_a = cam_b), 0) AS BIGINT) AS n_points, count(*) FILTER (WHERE cam_a <> cam_b) AS degree,
CAST(coalesce(sum(n) FILTER (WHERE cam_a <> cam_b), 0) AS BIGINT) AS n_shared, count(*) FILTER (WHERE cam_a <> cam_b) = 0 AS is_isolated, count(*) FILTER (WHERE cam_a <> cam_b) = 1 AS is_leaf
FROM part_cams c LEFT JOIN pairs p ON p.cam_a = c.cam_id GROUP BY c.cam_id""")
def coverage_report(spark, sf_dir):
    return coverage.coverage_report(obs_of(spark, sf_dir), cams_of(spark, True))


@query(f"AND {PAIRS} SELECT cam_a, cam_b, n, CASE WHEN n >= 200 THEN 'good' WHEN n >= 50 THEN 'marginal' ELSE 'insufficient' END AS quality FROM pairs WHERE cam_a < cam_b")
def link_quality(spark, sf_dir):
    return coverage.link_report(obs_of(spark, sf_dir))


@query("SELECT cam_id, CASE WHEN cam_id < 4 THEN 0 ELSE cam_id END AS component FROM part_cams")
def camera_components(spark, sf_dir):
    return coverage.camera_components(obs_of(spark, sf_dir), cams_of(spark, True))


@query("SELECT 'critical' AS severity, CAST(0 AS INTEGER) AS ordinal, CAST(4 AS BIGINT) AS cam_id, 'camera shares no points' AS message UNION ALL SELECT 'critical', 1, NULL, 'cameras form 2 groups'")
def structural_warnings(spark, sf_dir):
    return coverage.structural_warnings(obs_of(spark, sf_dir), cams_of(spark, True))


@query("""SELECT a.cam_id AS cam_a, b.cam_id AS cam_b, count(*) AS n, round(sum(a.img_loc_x - b.img_loc_x), 4) + 0 AS dx FROM obs a JOIN obs b USING (sync_index, object_id, keypoint_id)
WHERE a.cam_id < b.cam_id GROUP BY 1, 2 HAVING count(*) >= 4""")
def camera_pairs(spark, sf_dir):
    rows = coverage.pair_correspondences(obs_of(spark, sf_dir))
    return rounded(rows.groupBy("cam_a", "cam_b").agg(F.count("*").alias("n"), F.sum(F.col("x_a") - F.col("x_b")).alias("dx")), 4)


# --- projection, residuals, filters on them --------------------------------------------------------

PROJ = """proj AS (SELECT *, fx * (a * rad + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + cx AS u, fy * (b * rad + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + cy AS v FROM (
SELECT *, 1 + r2 * (k1 + r2 * (k2 + r2 * k3)) AS rad FROM (SELECT *, a * a + b * b AS r2 FROM (SELECT *, xc / depth AS a, yc / depth AS b FROM (
SELECT w.*, c.*, r0 * x_coord + r1 * y_coord + r2 * z_coord + t0 AS xc, r3 * x_coord + r4 * y_coord + r5 * z_coord + t1 AS yc, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS depth
FROM world w CROSS JOIN (SELECT * RENAME (r2 AS r2) FROM {cams}) c)))))"""
# r2 names a rotation entry and a squared radius: the rotation's columns get other names first.
PROJ = PROJ.replace("SELECT *, 1 + r2 * (k1 + r2 * (k2 + r2 * k3)) AS rad", "SELECT *, 1 + q * (k1 + q * (k2 + q * k3)) AS rad").replace("a * a + b * b AS r2", "a * a + b * b AS q").replace("p2 * (r2 +", "p2 * (q +").replace("p1 * (r2 +", "p1 * (q +").replace("(SELECT * RENAME (r2 AS r2) FROM {cams})", "{cams}")
POSED = "(SELECT * FROM part_cams WHERE r0 IS NOT NULL AND NOT ignored)"
ALL_PROJ, PART_PROJ = PROJ.format(cams="cams"), PROJ.format(cams=POSED)
ERR = f"""{PART_PROJ}, err AS (SELECT *, sqrt(error_x * error_x + error_y * error_y) AS euclidean_error FROM (
SELECT o.sync_index, o.cam_id, o.object_id, o.keypoint_id, p.u - o.img_loc_x AS error_x, p.v - o.img_loc_y AS error_y FROM obs o JOIN proj p USING (sync_index, cam_id, object_id, keypoint_id)))"""


@query(f"AND {ALL_PROJ} SELECT sync_index, cam_id, object_id, keypoint_id, round(u, 6) + 0 AS img_loc_x, round(v, 6) + 0 AS img_loc_y, round(depth, 6) + 0 AS depth FROM proj")
def project_points(spark, sf_dir):
    return rounded(reconstruction.project(events.world(obs_of(spark, sf_dir)), cams_of(spark)).drop("width", "height"))


@query(f"AND {ALL_PROJ} SELECT cam_id, count(*) AS n FROM proj WHERE depth > 0 AND u >= 0 AND u < width AND v >= 0 AND v < height GROUP BY cam_id")
def visible_points(spark, sf_dir):
    return reconstruction.visible(reconstruction.project(events.world(obs_of(spark, sf_dir)), cams_of(spark))).groupBy("cam_id").agg(F.count("*").alias("n"))


def _residuals(spark, sf_dir) -> DataFrame:
    obs = obs_of(spark, sf_dir)
    return reconstruction.residuals(obs, events.world(obs), cams_of(spark, True))


@query(f"AND {ERR} SELECT sync_index, cam_id, object_id, keypoint_id, round(error_x, 6) + 0 AS error_x, round(error_y, 6) + 0 AS error_y, round(euclidean_error, 6) + 0 AS euclidean_error FROM err")
def residuals(spark, sf_dir):
    return rounded(_residuals(spark, sf_dir))


@query(f"""AND {ERR} SELECT CASE WHEN grouping_id(cam_id, object_id, keypoint_id) = 7 THEN 'overall' WHEN grouping_id(cam_id, object_id, keypoint_id) = 3 THEN 'camera' ELSE 'point' END AS facet,
cam_id, object_id, keypoint_id, count(*) AS n, round(sqrt(avg(euclidean_error * euclidean_error)), 4) + 0 AS rmse FROM err GROUP BY GROUPING SETS ((), (cam_id), (object_id, keypoint_id))""")
def reprojection_report(spark, sf_dir):
    return rounded(reconstruction.reprojection_summary(_residuals(spark, sf_dir)), 4)


@query(f"""SELECT c.cam_id, count(o.sync_index) AS n_total, count(o.sync_index) FILTER (WHERE c.r0 IS NULL OR c.ignored OR (o.sync_index % 5 = 0)) AS n_unmatched,
round(coalesce(count(o.sync_index) FILTER (WHERE c.r0 IS NULL OR c.ignored OR (o.sync_index % 5 = 0)) / nullif(CAST(count(o.sync_index) AS DOUBLE), 0), 0), 6) + 0 AS rate
FROM part_cams c LEFT JOIN obs o USING (cam_id) GROUP BY c.cam_id""")
def unmatched_rate(spark, sf_dir):
    obs = obs_of(spark, sf_dir)
    return rounded(reconstruction.unmatched(obs, events.world(obs).filter("sync_index % 5 <> 0"), cams_of(spark, True)))


@query(f"""AND {ERR}, q AS (SELECT unnest([0.5, 0.95, 0.975, 0.99]) AS percentile, unnest(quantile_cont(euclidean_error, [0.5, 0.95, 0.975, 0.99])) AS error FROM err)
SELECT CAST(percentile AS DOUBLE) AS percentile, round(error, 6) + 0 AS error FROM q""")
def error_percentiles(spark, sf_dir):
    return rounded(reconstruction.error_percentiles(_residuals(spark, sf_dir)))


@query(f"AND {ERR} SELECT round(avg(CAST(euclidean_error > 500 AS DOUBLE)) * 100, 6) + 0 AS percent_above FROM err")
def percent_above(spark, sf_dir):
    return rounded(reconstruction.percent_above(_residuals(spark, sf_dir), 500.0))


FLOOR = """, flagged AS (SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY euclidean_error) AS place, count(*) FILTER (WHERE keep) OVER (PARTITION BY cam_id) AS kept FROM cand),
lim AS (SELECT cam_id, max(euclidean_error) AS lim FROM flagged WHERE place <= {least} AND kept < {least} GROUP BY cam_id)
SELECT sync_index, f.cam_id, object_id, keypoint_id FROM flagged f LEFT JOIN lim USING (cam_id) WHERE keep OR euclidean_error <= lim"""


@query(f"AND {ERR}, cand AS (SELECT *, euclidean_error <= 80 AS keep FROM err)" + FLOOR.format(least=40))
def filter_by_pixels(spark, sf_dir):
    return reconstruction.within_pixels(_residuals(spark, sf_dir), 80.0, 40).select(*IMAGE_KEY)


@query(f"AND {ERR}, cand AS (SELECT *, euclidean_error <= quantile_cont(euclidean_error, 0.9) OVER (PARTITION BY cam_id) AS keep FROM err)" + FLOOR.format(least=10))
def filter_by_percentile(spark, sf_dir):
    return reconstruction.without_worst(_residuals(spark, sf_dir), 10.0).select(*IMAGE_KEY)


KEPT = FLOOR.format(least=1).replace("\nSELECT sync_index, f.cam_id", ", kept AS (SELECT sync_index, f.cam_id") + ")"


@query(f"AND {ERR}, cand AS (SELECT *, euclidean_error <= 400 AS keep FROM err)" + KEPT + " SELECT sync_index, object_id, keypoint_id, round(x_coord, 6) + 0 AS x_coord FROM world SEMI JOIN kept USING (sync_index, object_id, keypoint_id)")
def prune_world(spark, sf_dir):
    obs = obs_of(spark, sf_dir)
    kept = reconstruction.within_pixels(_residuals(spark, sf_dir), 400.0, 1)
    return rounded(reconstruction.apply_filter(obs, events.world(obs), kept)[1].select(*WORLD_KEY, "x_coord"))


@query("SELECT round(1000.0 / median(fx), 6) + 0 AS f_scale FROM cams")
def focal_scale(spark, sf_dir):
    return rounded(quality.focal_scale(cams_of(spark), 1000.0))


def _seen(spark, sf_dir) -> DataFrame:
    """Noise-free observations: the world points in the cameras that observed them."""
    obs = obs_of(spark, sf_dir)
    found = reconstruction.project(events.world(obs), cams_of(spark)).select(*IMAGE_KEY, "img_loc_x", "img_loc_y")
    return found.join(obs.select(*IMAGE_KEY, "frame_time"), IMAGE_KEY)


@query("""SELECT sync_index, object_id, keypoint_id, round(x_coord, 6) + 0 AS x_coord, round(y_coord, 6) + 0 AS y_coord, round(z_coord, 6) + 0 AS z_coord, n AS n_views, round(t, 9) + 0 AS frame_time
FROM world JOIN (SELECT sync_index, object_id, keypoint_id, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 2) USING (sync_index, object_id, keypoint_id)
JOIN (SELECT sync_index, avg(frame_time) AS t FROM obs GROUP BY 1) USING (sync_index)""")
def triangulate(spark, sf_dir):
    found = reconstruction.triangulate(_seen(spark, sf_dir), cams_of(spark))
    return rounded(rounded(found, 6, "x_coord", "y_coord", "z_coord"), 9, "frame_time")


@query("""SELECT o.sync_index, cam_id, o.object_id, o.keypoint_id, round(xc / zc, 6) + 0 AS und_x, round(yc / zc, 6) + 0 AS und_y FROM (SELECT o.*, w.x_coord, r0 * x_coord + r1 * y_coord + r2 * z_coord + t0 AS xc,
r3 * x_coord + r4 * y_coord + r5 * z_coord + t1 AS yc, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS zc FROM obs o JOIN world w USING (sync_index, object_id, keypoint_id) JOIN cams USING (cam_id)) o""")
def undistort_points(spark, sf_dir):
    return rounded(reconstruction.undistort(_seen(spark, sf_dir), cams_of(spark)).select(*IMAGE_KEY, "und_x", "und_y"))


ROUND = """seen AS (SELECT *, atan(q) AS th, CASE WHEN q > 1e-12 THEN atan(q) / q ELSE 1 END AS bend FROM (SELECT *, sqrt(a * a + b * b) AS q FROM (SELECT w.*, c.*, xc / zc AS a, yc / zc AS b FROM (SELECT w.sync_index, w.object_id, w.keypoint_id, c.*,
r0 * x_coord + r1 * y_coord + r2 * z_coord + t0 AS xc, r3 * x_coord + r4 * y_coord + r5 * z_coord + t1 AS yc, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS zc FROM world w CROSS JOIN round_cams c) w, (SELECT 1) c))),
proj AS (SELECT *, CASE WHEN fisheye THEN a * bend * (1 + th ** 2 * (k1 + th ** 2 * (k2 + th ** 2 * (p1 + th ** 2 * p2)))) ELSE a * (1 + q ** 2 * (k1 + q ** 2 * (k2 + q ** 2 * k3))) + 2 * p1 * a * b + p2 * (q ** 2 + 2 * a * a) END AS da,
CASE WHEN fisheye THEN b * bend * (1 + th ** 2 * (k1 + th ** 2 * (k2 + th ** 2 * (p1 + th ** 2 * p2)))) ELSE b * (1 + q ** 2 * (k1 + q ** 2 * (k2 + q ** 2 * k3))) + p1 * (q ** 2 + 2 * b * b) + 2 * p2 * a * b END AS db FROM seen)"""


def round_cams_of(spark: SparkSession) -> DataFrame:
    return rig.cameras(spark, ROUND_RIG)


@query(f"AND {ROUND} SELECT sync_index, cam_id, object_id, keypoint_id, round(fx * da + cx, 6) + 0 AS img_loc_x, round(fy * db + cy, 6) + 0 AS img_loc_y FROM proj")
def fisheye_projection(spark, sf_dir):
    """Projection where one camera of the rig has a fisheye lens."""
    return rounded(reconstruction.project(events.world(obs_of(spark, sf_dir)), round_cams_of(spark)).select(*IMAGE_KEY, "img_loc_x", "img_loc_y"))


@query(f"AND {ROUND} SELECT sync_index, cam_id, object_id, keypoint_id, round(a, 6) + 0 AS und_x, round(b, 6) + 0 AS und_y FROM proj")
def fisheye_undistort(spark, sf_dir):
    seen = reconstruction.project(events.world(obs_of(spark, sf_dir)), round_cams_of(spark))
    return rounded(reconstruction.undistort(seen, round_cams_of(spark)).select(*IMAGE_KEY, "und_x", "und_y"))


@query("""SELECT sync_index, object_id, keypoint_id, round(x_coord, 5) + 0 AS x_coord, round(y_coord, 5) + 0 AS y_coord, round(z_coord, 5) + 0 AS z_coord FROM world SEMI JOIN (SELECT sync_index, object_id, keypoint_id FROM obs GROUP BY ALL HAVING count(*) >= 2) USING (sync_index, object_id, keypoint_id)""")
def fisheye_triangulate(spark, sf_dir):
    obs = obs_of(spark, sf_dir)
    seen = reconstruction.project(events.world(obs), round_cams_of(spark)).select(*IMAGE_KEY, "img_loc_x", "img_loc_y").join(obs.select(*IMAGE_KEY, "frame_time"), IMAGE_KEY)
    return rounded(reconstruction.triangulate(seen, round_cams_of(spark)).select(*WORLD_KEY, "x_coord", "y_coord", "z_coord"), 5)


# --- trajectories ----------------------------------------------------------------------------------


def _gap_sql(table: str, track: str, values: list[str], strict: bool = False) -> str:
    w = f"OVER (PARTITION BY {track} ORDER BY sync_index)"
    ahead = ", ".join(f"lead({v}) {w} AS to_{v}" for v in values)
    limit = "AND gap <= 3" if strict else ""
    return f"""AND ahead AS (SELECT *, lead(sync_index) {w} - sync_index - 1 AS gap, {ahead} FROM {table}),
filled AS (SELECT *, least(gap, 3) AS k, unnest(range(1, CAST(least(gap, 3) AS BIGINT) + 1)) AS j FROM ahead WHERE gap > 0 {limit})
SELECT sync_index, {track}, {", ".join(f"round({v}, 6) + 0 AS {v}" for v in values)} FROM {table} UNION ALL
SELECT sync_index + j, {track}, {", ".join(f"round({v} + (to_{v} - {v}) * (CAST(j AS DOUBLE) / (k + 1)), 6) + 0" for v in values)} FROM filled"""


@query(_gap_sql("obs", "cam_id, object_id, keypoint_id", ["img_loc_x", "img_loc_y", "frame_time"]))
def fill_image_gaps(spark, sf_dir):
    return _obs_out(trajectories.fill_image_gaps(obs_of(spark, sf_dir)))


@query(_gap_sql("obs", "cam_id, object_id, keypoint_id", ["img_loc_x", "img_loc_y", "frame_time"], strict=True))
def fill_short_gaps(spark, sf_dir):
    return _obs_out(trajectories.fill_image_gaps(obs_of(spark, sf_dir), strict=True))


@query(_gap_sql("world", "object_id, keypoint_id", ["x_coord", "y_coord", "z_coord", "frame_time"]))
def fill_world_gaps(spark, sf_dir):
    return rounded(trajectories.fill_world_gaps(events.world(obs_of(spark, sf_dir))))


NAMES = {0: "nose", 1: "left_hand", 2: "right_hand", 3: "chest"}


@query("SELECT sync_index, " + ", ".join(f"round(avg({c}_coord) FILTER (WHERE keypoint_id = {k}), 6) + 0 AS {n}_{c}" for k, n in NAMES.items() for c in "xyz") + " FROM world GROUP BY sync_index")
def wide_points(spark, sf_dir):
    return rounded(trajectories.wide(events.world(obs_of(spark, sf_dir)), NAMES))


@query("""AND own AS (SELECT * FROM world WHERE object_id = (SELECT object_id FROM world GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)), k AS (SELECT keypoint_id, row_number() OVER (ORDER BY keypoint_id) - 1 AS place FROM (SELECT DISTINCT keypoint_id FROM own)),
j AS (SELECT f.sync_index, k.keypoint_id, place, x_coord, y_coord, z_coord FROM (SELECT DISTINCT sync_index FROM own) f CROSS JOIN k LEFT JOIN own USING (sync_index, keypoint_id))
SELECT sync_index, place, """ + ", ".join(
    f"round(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY keypoint_id ORDER BY sync_index ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY keypoint_id ORDER BY sync_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) + 0 AS {c}"
    for c in ("x_coord", "y_coord", "z_coord")
) + " FROM j")
def scene_frames(spark, sf_dir):
    """The frames of a scene file, read back from their JSON."""
    frames = scenes.scene_frames(events.world(obs_of(spark, sf_dir))).select("sync_index", F.from_json(F.to_json("joints"), "array<array<double>>").alias("joints"))
    rows = frames.select("sync_index", F.posexplode("joints").alias("place", "p"))
    return rows.select("sync_index", F.col("place").cast("long").alias("place"), *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("x_coord", "y_coord", "z_coord"))))


@query("""AND own AS (SELECT * FROM world WHERE object_id = (SELECT object_id FROM world GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
grid AS (SELECT object_id, keypoint_id, s AS sync_index FROM (SELECT DISTINCT object_id, keypoint_id FROM own), (SELECT unnest(range(min(sync_index), max(sync_index) + 1)) AS s FROM own)),
j AS (SELECT grid.*, x_coord, y_coord, z_coord FROM grid LEFT JOIN own USING (sync_index, object_id, keypoint_id))
SELECT sync_index, object_id, keypoint_id, """ + ", ".join(
    f"round(coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY object_id, keypoint_id ORDER BY sync_index ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY object_id, keypoint_id ORDER BY sync_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0 AS {c}"
    for c in ("x_coord", "y_coord", "z_coord")
) + " FROM j")
def dense_trajectories(spark, sf_dir):
    return rounded(trajectories.dense_trajectories(events.world(obs_of(spark, sf_dir))))


@query("AND f AS (SELECT sync_index, avg(frame_time) AS t FROM obs GROUP BY 1) SELECT sync_index, round_even(t - (SELECT min(t) FROM f), 3) + 0 AS time FROM f")
def rebased_times(spark, sf_dir):
    return trajectories.rebased_times(obs_of(spark, sf_dir)).withColumn("time", F.col("time") + 0.0)


@query("AND f AS (SELECT sync_index, avg(frame_time) AS t FROM obs GROUP BY 1), d AS (SELECT t - lag(t) OVER (ORDER BY t) AS dt FROM f) SELECT CAST(floor(avg(CASE WHEN dt = 0 THEN 0 ELSE 1 / dt END)) AS BIGINT) AS frame_rate FROM d WHERE dt IS NOT NULL")
def frame_rate(spark, sf_dir):
    return trajectories.frame_rate(obs_of(spark, sf_dir))


# --- timing ----------------------------------------------------------------------------------------


def _clocks(spark, sf_dir) -> DataFrame:
    """Each camera's distinct frame times."""
    return obs_of(spark, sf_dir).groupBy("cam_id", "sync_index").agg(F.min("frame_time").alias("frame_time")).select("cam_id", "frame_time")


CLOCKS = "clocks AS (SELECT cam_id, min(frame_time) AS frame_time FROM obs GROUP BY cam_id, sync_index)"


@query(f"AND {CLOCKS} SELECT cam_id, row_number() OVER (PARTITION BY cam_id ORDER BY frame_time) - 1 AS frame_index, round(frame_time, 6) + 0 AS frame_time FROM clocks")
def frame_index(spark, sf_dir):
    return rounded(timing.dense_frame_index(_clocks(spark, sf_dir)))


@query(f"AND {CLOCKS} SELECT DISTINCT cam_id, rank() OVER (ORDER BY floor(frame_time)) - 1 AS frame_index, floor(frame_time) AS frame_time FROM clocks WHERE cam_id = 2")
def ranked_frame_index(spark, sf_dir):
    return timing.ranked_frame_index(_clocks(spark, sf_dir).withColumn("frame_time", F.floor("frame_time").cast("double")), 2)


@query("SELECT cam_id, n AS frame_index, round(n * ((20 / 10.0 + 30 / 10.0 + 40 / 20.0) / 3) / frame_count, 6) + 0 AS frame_time FROM (SELECT cam_id, frame_count, unnest(range(frame_count)) AS n FROM (VALUES (CAST(0 AS BIGINT), 20), (1, 30), (2, 40)) m(cam_id, frame_count))")
def inferred_times(spark, sf_dir):
    return rounded(timing.inferred_times(spark.createDataFrame([(0, 20, 10.0), (1, 30, 10.0), (2, 40, 20.0)], "cam_id long, frame_count long, fps double")))


@query(f"AND {CLOCKS} SELECT round(avg((n - 1) / span), 6) + 0 AS fps FROM (SELECT count(*) AS n, max(frame_time) - min(frame_time) AS span FROM clocks GROUP BY cam_id) WHERE n >= 2 AND span > 0")
def mean_fps(spark, sf_dir):
    return rounded(timing.mean_fps(_clocks(spark, sf_dir)))


@query(f"AND {CLOCKS} SELECT cam_id, CAST(0 AS BIGINT) AS first_frame, count(*) - 1 AS last_frame FROM clocks GROUP BY cam_id")
def frame_bounds(spark, sf_dir):
    return timing.frame_bounds(timing.dense_frame_index(_clocks(spark, sf_dir)))


@query("SELECT DISTINCT o.sync_index, c.cam_id, o.sync_index AS frame_index FROM (SELECT DISTINCT sync_index FROM obs) o, cams c")
def align_equal_clocks(spark, sf_dir):
    frames = obs_of(spark, sf_dir).select("sync_index").distinct().crossJoin(F.broadcast(cams_of(spark).select("cam_id")))
    clocks = frames.select("cam_id", F.col("sync_index").alias("frame_index"), (F.col("sync_index") / 30.0).alias("frame_time"))
    return timing.align(clocks).select("sync_index", "cam_id", "frame_index")


@query("""AND RECURSIVE c AS (SELECT cam_id, list(t ORDER BY t) AS ts FROM (SELECT cam_id, min(frame_time) AS t FROM obs GROUP BY cam_id, sync_index) GROUP BY cam_id),
tt AS (SELECT list(ts ORDER BY cam_id) AS tt, list(cam_id ORDER BY cam_id) AS ids FROM c),
step AS (SELECT CAST(-1 AS BIGINT) AS sync, [CAST(0 AS BIGINT) FOR x IN ids] AS pos, [CAST(0 AS BIGINT) FOR x IN ids] AS used, [false FOR x IN ids] AS joins, true AS any_joins, true AS going FROM tt
UNION ALL SELECT sync + CASE WHEN any_now THEN 1 ELSE 0 END, [pos[i] + CASE WHEN any_now THEN CASE WHEN j[i] THEN 1 ELSE 0 END WHEN i = list_position(now, list_min(now)) THEN 1 ELSE 0 END FOR i IN ks], pos, j, any_now, true
FROM (SELECT *, list_contains(j, true) AS any_now FROM (SELECT *, [now[i] IS NOT NULL AND NOT (now[i] > e[i] OR e[i] - now[i] < now[i] - l[i]) FOR i IN ks] AS j
FROM (SELECT *, [coalesce(list_min([nxt[o] FOR o IN ks IF o <> i]), CAST('inf' AS DOUBLE)) FOR i IN ks] AS e, [coalesce(list_max([now[o] FOR o IN ks IF o <> i]), CAST('-inf' AS DOUBLE)) FOR i IN ks] AS l
FROM (SELECT *, [tt[i][pos[i] + 1] FOR i IN ks] AS now, [tt[i][pos[i] + 2] FOR i IN ks] AS nxt FROM (SELECT step.*, tt.tt, range(1, len(ids) + 1) AS ks FROM step, tt))))) WHERE list_min(now) IS NOT NULL),
flat AS (SELECT sync, used, joins, unnest(range(1, len(ids) + 1)) AS i, ids FROM step, tt WHERE any_joins AND sync >= 0)
SELECT sync AS sync_index, ids[i] AS cam_id, CASE WHEN joins[i] THEN used[i] END AS frame_index FROM flat""")
def align_clocks(spark, sf_dir):
    """The cameras' own frame times, of which some come early, late or not at all; in segments of 400 frames, so that several are joined."""
    own = obs_of(spark, sf_dir).groupBy("cam_id", "sync_index").agg(F.min("frame_time").alias("frame_time"))
    return timing.align(timing.dense_frame_index(own), segment=400).select("sync_index", "cam_id", "frame_index")


# --- scale, rigidity, geometry ---------------------------------------------------------------------

OBJ = """frames AS (SELECT w.sync_index, w.object_id, w.keypoint_id, x_coord, y_coord, z_coord, ox, oy, cams FROM world w JOIN (SELECT sync_index, object_id, keypoint_id, arg_min(obj_loc_x, cam_id) AS ox,
arg_min(obj_loc_y, cam_id) AS oy, list(DISTINCT cam_id) AS cams FROM obs GROUP BY ALL) USING (sync_index, object_id, keypoint_id)),
p AS (SELECT a.sync_index, a.object_id, sqrt((a.x_coord - b.x_coord) ** 2 + (a.y_coord - b.y_coord) ** 2 + (a.z_coord - b.z_coord) ** 2) AS m, sqrt((a.ox - b.ox) ** 2 + (a.oy - b.oy) ** 2) AS d
FROM frames a JOIN frames b ON a.sync_index = b.sync_index AND a.object_id = b.object_id AND a.keypoint_id < b.keypoint_id),
sf AS (SELECT p.sync_index, p.object_id, any_value(n_corners) AS n_corners, any_value(n_cameras) AS n_cameras, count(*) AS n_pairs, sqrt(avg((m - d) ** 2)) AS rmse, avg(m - d) AS mean_error, max(abs(m - d)) AS max_error,
sum((m - d) ** 2) AS sse, sum((m - d) ** 2) / max(d) ** 2 AS relative_sse FROM p JOIN (SELECT sync_index, object_id, count(*) AS n_corners, len(list_distinct(flatten(list(cams)))) AS n_cameras FROM frames GROUP BY ALL
HAVING count(*) >= 3) c ON p.sync_index = c.sync_index AND p.object_id = c.object_id GROUP BY 1, 2)"""


def _scale(spark, sf_dir) -> DataFrame:
    obs = obs_of(spark, sf_dir)
    return quality.scale_frame_errors(obs, events.world(obs))


@query(f"AND {OBJ} SELECT sync_index, object_id, n_corners, CAST(n_cameras AS INTEGER) AS n_cameras, n_pairs, round(rmse, 9) + 0 AS rmse, round(mean_error, 9) + 0 AS mean_error, round(max_error, 9) + 0 AS max_error FROM sf")
def scale_frame_errors(spark, sf_dir):
    return rounded(_scale(spark, sf_dir).select("sync_index", "object_id", "n_corners", "n_cameras", "n_pairs", "rmse", "mean_error", "max_error"), 9)


@query(f"""AND {OBJ} SELECT count(*) AS n_frames, round(sqrt(sum(sse) / sum(n_pairs)) * 1000, 6) + 0 AS pooled_rmse_mm, round(sqrt(sum(relative_sse) / sum(n_pairs)) * 100, 6) + 0 AS pooled_relative_pct,
round(sum(mean_error * n_pairs) / sum(n_pairs) * 1000, 6) + 0 AS bias_mm, round(max(rmse) * 1000, 6) + 0 AS max_rmse_mm FROM sf""")
def scale_report(spark, sf_dir):
    return rounded(quality.scale_report(_scale(spark, sf_dir)).select("n_frames", "pooled_rmse_mm", "pooled_relative_pct", "bias_mm", "max_rmse_mm"))


@query(f"AND {OBJ} SELECT CASE WHEN object_id = 1 THEN 'static' ELSE 'moving' END AS side, object_id, round(sqrt(sum(sse) / sum(n_pairs)) * 1000, 6) + 0 AS rmse_mm FROM sf GROUP BY GROUPING SETS ((side), (side, object_id))".replace("SELECT CASE WHEN object_id = 1 THEN 'static' ELSE 'moving' END AS side, object_id,", "SELECT side, object_id,").replace("FROM sf GROUP BY", "FROM (SELECT *, CASE WHEN object_id = 1 THEN 'static' ELSE 'moving' END AS side FROM sf) GROUP BY"))
def scale_by_object(spark, sf_dir):
    return rounded(quality.pooled_by_object(_scale(spark, sf_dir), [1]))


@query(f"AND {OBJ}, {ERR} SELECT object_id, object_id = 1 AS is_static, round(coalesce(px, 0), 6) + 0 AS reprojection_rmse, round(sqrt(sum(relative_sse) / sum(n_pairs)) * 100, 6) + 0 AS relative_rmse_pct, round(sqrt(sum(sse) / sum(n_pairs)) * 1000, 6) + 0 AS rmse_mm, CAST(sum(n_pairs) AS BIGINT) AS n_pairs FROM sf LEFT JOIN (SELECT object_id, sqrt(avg(euclidean_error ** 2)) AS px FROM err GROUP BY 1) USING (object_id) GROUP BY object_id, px")
def marker_quality(spark, sf_dir):
    return rounded(quality.marker_quality(_scale(spark, sf_dir), _residuals(spark, sf_dir), [1]))


@query(f"AND {OBJ} SELECT round(median(rmse) * 1000, 6) + 0 AS median_rmse_mm, arg_min(sync_index, (-rmse, sync_index)) AS worst_sync_index FROM (SELECT sync_index, object_id, round(rmse, 9) AS rmse FROM sf)")
def scale_median_and_worst(spark, sf_dir):
    frames = _scale(spark, sf_dir).withColumn("rmse", F.round("rmse", 9))
    return rounded(quality.scale_report(frames).select("median_rmse_mm", "worst_sync_index"))


@query(f"""AND d AS (SELECT cam_id, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS z FROM world CROSS JOIN {POSED}) SELECT cam_id, count(*) AS n, round(quantile_cont(z, 0.95) / quantile_cont(z, 0.05), 6) + 0 AS depth_ratio FROM d WHERE z > 0 GROUP BY cam_id""")
def depth_ratios(spark, sf_dir):
    return rounded(quality.depth_ratios(events.world(obs_of(spark, sf_dir)), cams_of(spark, True)))


DISTANCES = [(0, 0, 0, 0, 1, 0.05, 0.001), (1, 0, 0, 0, 2, 0.05, 0.001), (2, 1, 0, 1, 3, 0.07, 0.001), (3, 0, 0, 1, 0, 0.2, 0.002)]
D_KIND = "constraint_id long, object_id_a long, keypoint_id_a long, object_id_b long, keypoint_id_b long, distance double, sigma double"
VIOLATIONS = f"""dist AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b}, {c}, {d}, {e}, CAST({f} AS DOUBLE), CAST({g} AS DOUBLE))" for a, b, c, d, e, f, g in DISTANCES)}) v(constraint_id, oa, ka, ob, kb, distance, sigma)),
vio AS (SELECT constraint_id, a.sync_index, oa, ob, distance, sqrt((a.x_coord - b.x_coord) ** 2 + (a.y_coord - b.y_coord) ** 2 + (a.z_coord - b.z_coord) ** 2) AS measured FROM dist
JOIN world a ON a.object_id = oa AND a.keypoint_id = ka JOIN world b ON b.object_id = ob AND b.keypoint_id = kb AND a.sync_index = b.sync_index)"""


def _violations(spark, sf_dir) -> DataFrame:
    return quality.rigidity_violations(events.world(obs_of(spark, sf_dir)), spark.createDataFrame(DISTANCES, D_KIND))


@query(f"AND {VIOLATIONS} SELECT CAST(constraint_id AS BIGINT) AS constraint_id, sync_index, 'corner' AS kind, round(measured, 9) + 0 AS measured, round(measured - distance, 9) + 0 AS violation FROM vio")
def rigidity_violations(spark, sf_dir):
    return rounded(_violations(spark, sf_dir).select("constraint_id", "sync_index", "kind", "measured", "violation"), 9)


@query(f"""AND {VIOLATIONS}, e AS (SELECT *, measured - distance AS v, CASE WHEN oa = ob THEN [oa] ELSE [oa, ob] END AS objs FROM vio), u AS (SELECT *, unnest(objs) AS object_id FROM e),
a AS (SELECT CAST(NULL AS BIGINT) AS object_id, v, distance FROM e UNION ALL SELECT object_id, v, distance FROM u)
SELECT object_id, count(*) AS n, round(sqrt(avg(v * v)) * 1000, 6) + 0 AS rmse_mm, round(max(abs(v)) * 1000, 6) + 0 AS max_mm, round(sqrt(avg((v / distance) ** 2)) * 100, 6) + 0 AS relative_rmse_pct FROM a GROUP BY object_id""")
def rigidity_report(spark, sf_dir):
    return rounded(quality.rigidity_report(_violations(spark, sf_dir)))


@query(f"AND {VIOLATIONS} SELECT CAST(constraint_id AS BIGINT) AS constraint_id, count(DISTINCT sync_index) AS n_frames FROM vio GROUP BY 1")
def firing_constraints(spark, sf_dir):
    return quality.firing_constraints(_violations(spark, sf_dir))


@query(f"AND {VIOLATIONS} SELECT CAST(oa AS BIGINT) AS object_id, round(sqrt(avg((measured - distance) ** 2)), 9) + 0 AS rmse, round(max(distance), 9) + 0 AS largest FROM vio WHERE oa = ob GROUP BY 1 HAVING sqrt(avg((measured - distance) ** 2)) > 0.05 * max(distance)")
def moving_static_markers(spark, sf_dir):
    return rounded(quality.moving_static_markers(_violations(spark, sf_dir), 0.05), 9)


@query("""AND c AS (SELECT sync_index, object_id, avg(x_coord) AS x, avg(y_coord) AS y, avg(z_coord) AS z FROM world GROUP BY ALL HAVING count(*) = 4)
SELECT CAST(0 AS BIGINT) AS constraint_id, sync_index, 'centroid' AS kind, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 9) + 0 AS measured FROM c a JOIN c b USING (sync_index) WHERE a.object_id = 0 AND b.object_id = 1""")
def centroid_violations(spark, sf_dir):
    c = spark.createDataFrame([(0, 0, 1, 0.2, 0.001)], "constraint_id long, object_id_a long, object_id_b long, distance double, sigma double")
    return rounded(quality.centroid_violations(events.world(obs_of(spark, sf_dir)), c).select("constraint_id", "sync_index", "kind", "measured"), 9)


@query("SELECT a.object_id, count(*) AS n, round(median(sqrt((a.x_coord - b.x_coord) ** 2 + (a.y_coord - b.y_coord) ** 2 + (a.z_coord - b.z_coord) ** 2)), 9) + 0 AS median_length FROM world a JOIN world b USING (sync_index, object_id) WHERE a.keypoint_id = 0 AND b.keypoint_id = 3 GROUP BY 1")
def segment_lengths(spark, sf_dir):
    return rounded(quality.segment_lengths(events.world(obs_of(spark, sf_dir)), 0, 3), 9)


@query("""AND cues AS (SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT), CAST(1 AS BIGINT)), (1, 3, 0), (2, 999999, 0)) v(cue_id, sync_index, keypoint_id)),
f AS (SELECT cue_id, count(w.object_id) AS n, min(x_coord) AS x_coord FROM cues LEFT JOIN world w USING (sync_index, keypoint_id) GROUP BY cue_id)
SELECT cue_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS reason, CASE WHEN n = 1 THEN round(x_coord, 6) + 0 END AS x_coord FROM f""")
def depth_cues(spark, sf_dir):
    cues = spark.createDataFrame([(0, 2, 1), (1, 3, 0), (2, 999999, 0)], "cue_id long, sync_index long, keypoint_id long")
    return rounded(quality.depth_cues(cues, events.world(obs_of(spark, sf_dir))).select("cue_id", "reason", "x_coord"))


@query("AND l AS (SELECT sqrt((a.x_coord - b.x_coord) ** 2 + (a.y_coord - b.y_coord) ** 2 + (a.z_coord - b.z_coord) ** 2) AS m, 0.05 * (1 + a.object_id) AS t, 0.001 * (1 + a.sync_index % 3) AS s FROM world a JOIN world b USING (sync_index, object_id) WHERE a.keypoint_id = 0 AND b.keypoint_id = 1) SELECT round(sum(m * t / s ** 2) / sum(m * m / s ** 2), 9) + 0 AS scale, count(*) AS n FROM l")
def scale_factor(spark, sf_dir):
    w = events.world(obs_of(spark, sf_dir)).filter("keypoint_id < 2").groupBy("sync_index", "object_id").agg(
        F.count("*").alias("n"), *(F.max(F.when(F.col("keypoint_id") == k, F.col(f"{c}_coord"))).alias(f"{c}{k}") for k in (0, 1) for c in "xyz")).filter("n = 2")
    cues = w.select(
        F.sqrt(sum(((F.col(f"{c}0") - F.col(f"{c}1")) ** 2 for c in "xyz"), F.lit(0.0))).alias("measured"),
        (0.05 * (1 + F.col("object_id"))).alias("true_length"), (0.001 * (1 + F.col("sync_index") % 3)).alias("sigma"),
    )
    return rounded(quality.scale_factor(cues), 9)


@query("SELECT CAST(0 AS BIGINT) AS cue_a, CAST(2 AS BIGINT) AS cue_b UNION ALL SELECT 1, 2")
def disagreeing_cues(spark, sf_dir):
    return quality.disagreeing_cues(spark.createDataFrame([(0, 1.0, 1.0, 0.01), (1, 1.0, 1.01, 0.01), (2, 1.0, 1.5, 0.01)], "cue_id long, measured double, true_length double, sigma double"))


@query("SELECT round(z_coord, 9) + 0 AS floor FROM world QUALIFY row_number() OVER (ORDER BY z_coord) = floor((count(*) OVER () - 1) * 0.01) + 1")
def floor_height(spark, sf_dir):
    return rounded(quality.floor_height(events.world(obs_of(spark, sf_dir))), 9)


@query("SELECT round(avg(-(r0 * t0 + r3 * t1 + r6 * t2)), 6) + 0 AS x, round(avg(-(r1 * t0 + r4 * t1 + r7 * t2)), 6) + 0 AS y, round(avg(-(r2 * t0 + r5 * t1 + r8 * t2)), 6) + 0 AS z FROM part_cams WHERE r0 IS NOT NULL AND NOT ignored")
def camera_centroid(spark, sf_dir):
    return rounded(quality.camera_centroid(cams_of(spark, True)))


@query("""AND v AS (SELECT x / n AS x, y / n AS y, z / n AS z FROM (SELECT x, y, z, sqrt(x * x + y * y + z * z) AS n FROM (SELECT 0.1 * x_coord AS x, 0.1 * y_coord AS y, 1 + z_coord AS z FROM world))),
m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v), u AS (SELECT x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM m))
SELECT round(u.x, 6) + 0 AS up_x, round(u.y, 6) + 0 AS up_y, round(u.z, 6) + 0 AS up_z, round(median(degrees(acos(least(1, v.x * u.x + v.y * u.y + v.z * u.z)))), 5) + 0 AS median_angle FROM v, u GROUP BY u.x, u.y, u.z""")
def consensus_up(spark, sf_dir):
    w = events.world(obs_of(spark, sf_dir)).select((0.1 * F.col("x_coord")).alias("x"), (0.1 * F.col("y_coord")).alias("y"), (1 + F.col("z_coord")).alias("z"))
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    found = quality.consensus_up(w.select(*((F.col(c) / n).alias(c) for c in "xyz")))
    return rounded(rounded(found.drop("max_angle"), 6, "up_x", "up_y", "up_z"), 5, "median_angle")


CELL = "CAST(greatest(0, least(4, trunc(img_loc_x / (width / 5.0)))) AS INTEGER) AS col, CAST(greatest(0, least(4, trunc(img_loc_y / (height / 5.0)))) AS INTEGER) AS row_"


@query(f"AND g AS (SELECT cam_id, sync_index, {CELL} FROM obs JOIN cams USING (cam_id)) SELECT cam_id, sync_index, count(DISTINCT (col, row_)) AS n_cells FROM g GROUP BY ALL")
def grid_coverage(spark, sf_dir):
    return quality.grid_coverage(obs_of(spark, sf_dir), cams_of(spark))


@query(f"""AND g AS (SELECT cam_id, {CELL} FROM obs JOIN cams USING (cam_id)), c AS (SELECT cam_id, col, row_, count(*) AS n FROM g GROUP BY ALL)
SELECT x.cam_id, x.col, x.row_ AS "row", coalesce(n, 0) AS n FROM (SELECT cam_id, CAST(i AS INTEGER) AS col, CAST(j AS INTEGER) AS row_ FROM (SELECT DISTINCT cam_id FROM obs), range(5) a(i), range(5) b(j)) x LEFT JOIN c USING (cam_id, col, row_)""")
def grid_histogram(spark, sf_dir):
    return quality.grid_histogram(obs_of(spark, sf_dir), cams_of(spark))


FEATURES = """feat AS (SELECT cam_id, sync_index, avg(img_loc_x / width) AS mean_x, avg(img_loc_y / height) AS mean_y, stddev_samp(img_loc_x / width) AS std_x, stddev_samp(img_loc_y / height) AS std_y FROM obs JOIN cams USING (cam_id) GROUP BY 1, 2),
feats AS (SELECT *, CASE WHEN std_y > 1e-6 THEN std_x / std_y ELSE 1.0 END AS aspect FROM feat)"""


@query(f"AND {FEATURES} SELECT cam_id, sync_index, " + ", ".join(f"round({e}, {d}) + 0 AS {c}" for c, e, d in (("mean_x", "mean_x * 1920", 8), ("mean_y", "mean_y * 1080", 8), ("std_x", "std_x", 7), ("std_y", "std_y", 7), ("aspect", "aspect", 4))) + " FROM feats")
def pose_features(spark, sf_dir):
    found = quality.pose_features(obs_of(spark, sf_dir), cams_of(spark))
    found = found.withColumns({"mean_x": F.col("mean_x") * 1920, "mean_y": F.col("mean_y") * 1080})  # in pixels
    return rounded(rounded(rounded(found, 8, "mean_x", "mean_y"), 7, "std_x", "std_y"), 4, "aspect")


@query(f"""AND {FEATURES}, g AS (SELECT DISTINCT cam_id, {CELL} FROM obs JOIN cams USING (cam_id)),
s AS (SELECT cam_id, count(*) / 25.0 AS coverage, count(*) FILTER (WHERE col IN (0, 4) OR row_ IN (0, 4)) / 16.0 AS edge_coverage, count(*) FILTER (WHERE col IN (0, 4) AND row_ IN (0, 4)) / 4.0 AS corner_coverage FROM g GROUP BY 1),
d AS (SELECT cam_id, (var_pop(mean_x) + var_pop(mean_y) + var_pop(aspect)) / 3 AS diversity FROM feats GROUP BY 1)
SELECT cam_id, """ + ", ".join(f"CAST(round({c}, 6) AS DOUBLE) + 0 AS {c}" for c in ("coverage", "edge_coverage", "corner_coverage", "diversity")) + " FROM s JOIN d USING (cam_id)")
def intrinsic_quality(spark, sf_dir):
    return rounded(quality.intrinsic_quality(obs_of(spark, sf_dir), cams_of(spark)))


@query("""AND t AS (SELECT cam_id, sync_index, avg(img_loc_x) - 900 AS dx, avg(img_loc_y) - 500 AS dy FROM obs GROUP BY 1, 2), u AS (SELECT *, atan2(dy, dx) AS direction, sqrt(dx * dx + dy * dy) / 1000 AS magnitude FROM t),
b AS (SELECT *, CAST(trunc(((degrees(direction) + 360.0) % 360.0) / 45.0) AS INTEGER) % 8 AS bin FROM u WHERE magnitude >= 0.1)
SELECT cam_id, bin, arg_max(sync_index, (magnitude, -sync_index)) AS sync_index, round(max(magnitude), 6) + 0 AS magnitude FROM b GROUP BY 1, 2""")
def best_frames_by_tilt(spark, sf_dir):
    t = obs_of(spark, sf_dir).groupBy("cam_id", "sync_index").agg((F.avg("img_loc_x") - 900).alias("dx"), (F.avg("img_loc_y") - 500).alias("dy"))
    tilts = t.select("cam_id", "sync_index", F.atan2("dy", "dx").alias("direction"), (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 1000).alias("magnitude"))
    return rounded(quality.best_frames_by_tilt(tilts))


@query(f"""AND j AS (SELECT o.cam_id, img_loc_x, img_loc_y, width, height, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS z FROM obs o JOIN world USING (sync_index, object_id, keypoint_id) JOIN {POSED} USING (cam_id))
SELECT cam_id, round(max(z) / min(z), 6) + 0 AS depth_ratio, round((max(img_loc_x) - min(img_loc_x)) / any_value(width), 6) + 0 AS x_span, round((max(img_loc_y) - min(img_loc_y)) / any_value(height), 6) + 0 AS y_span,
round(avg(CAST(sqrt((img_loc_x - width / 2) ** 2 + (img_loc_y - height / 2) ** 2) > 0.6 * sqrt((width / 2) ** 2 + (height / 2) ** 2) AS DOUBLE)), 6) + 0 AS peripheral FROM j GROUP BY cam_id""")
def capture_suitability(spark, sf_dir):
    obs = obs_of(spark, sf_dir)
    return rounded(quality.capture_suitability(obs, events.world(obs), cams_of(spark, True)))


@query("SELECT a.sync_index, a.object_id, s.segment, round(a.x_coord, 6) + 0 AS ax, round(b.x_coord, 6) + 0 AS bx FROM (VALUES ('top', 0, 1), ('side', 0, 2)) s(segment, ka, kb) JOIN world a ON a.keypoint_id = ka JOIN world b ON b.keypoint_id = kb AND a.sync_index = b.sync_index AND a.object_id = b.object_id")
def wireframe(spark, sf_dir):
    s = spark.createDataFrame([("top", 0, 1), ("side", 0, 2)], "segment string, keypoint_a long, keypoint_b long")
    return rounded(quality.wireframe(events.world(obs_of(spark, sf_dir)), s).select("sync_index", "object_id", "segment", "ax", "bx"))


@query(f"""AND {ERR}, d AS (SELECT cam_id, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS z FROM world CROSS JOIN {POSED}), q AS (SELECT cam_id, quantile_cont(z, 0.95) / quantile_cont(z, 0.05) AS depth_ratio FROM d WHERE z > 0 GROUP BY 1)
SELECT cam_id, n_observed, n, round(rmse, 4) + 0 AS rmse, round(depth_ratio, 4) + 0 AS depth_ratio FROM (SELECT cam_id, count(*) AS n_observed FROM obs GROUP BY 1) JOIN (SELECT cam_id, count(*) AS n, sqrt(avg(euclidean_error ** 2)) AS rmse FROM err GROUP BY 1) USING (cam_id) JOIN q USING (cam_id)""")
def camera_quality(spark, sf_dir):
    obs, cams = obs_of(spark, sf_dir), cams_of(spark, True)
    return rounded(quality.camera_quality(obs, _residuals(spark, sf_dir), events.world(obs), cams), 4)


@query(f"AND {ERR}, e AS (SELECT cam_id, sqrt(avg(euclidean_error ** 2)) AS rmse FROM err GROUP BY 1) SELECT cam_id, CASE WHEN rmse < 300 THEN 'good' WHEN rmse < 900 THEN 'fair' ELSE 'poor' END AS badge FROM e")
def quality_badges(spark, sf_dir):
    e = reconstruction.camera_errors(_residuals(spark, sf_dir), cams_of(spark, True))
    return e.select("cam_id", scalars.badge(F.col("rmse"), [(300.0, "good"), (900.0, "fair")], "poor").alias("badge"))


@query("SELECT event_id, CAST(CASE event_id % 4 WHEN 1 THEN value WHEN 2 THEN 500 - event_id % 500 WHEN 3 THEN 500 - value ELSE event_id % 500 END AS DOUBLE) AS x, CAST(CASE event_id % 4 WHEN 1 THEN 500 - event_id % 500 WHEN 2 THEN 500 - value WHEN 3 THEN event_id % 500 ELSE value END AS DOUBLE) AS y FROM events")
def unrotate_points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    x, y = scalars.unrotate((F.col("event_id") % 500).cast("double"), F.col("value"), F.col("event_id") % 4, F.lit(500.0), F.lit(500.0))
    return e.select("event_id", x.alias("x"), y.alias("y"))


@query("""AND v AS (SELECT event_id, [CAST((event_id * 7 + i * 13) % 31 AS DOUBLE) / 31 FOR i IN range(8)] AS a, [CAST((event_id * 5 + i * 11) % 29 AS DOUBLE) / 29 FOR i IN range(6)] AS b FROM events)
SELECT event_id, CAST(list_position(a, list_max(a)) - 1 AS DOUBLE) / 2 AS x, CAST(list_position(b, list_max(b)) - 1 AS DOUBLE) / 2 AS y, round(greatest(0, least(1, list_max(a), list_max(b))), 6) + 0 AS confidence FROM v""")
def decode_axes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    make = lambda n, f, g, m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((F.col("event_id") * f + i * g) % m).cast("double") / m)
    x, y, c = scalars.decode_axes(make(8, 7, 13, 31), make(6, 5, 11, 29), 2.0)
    return rounded(e.select("event_id", x.alias("x"), y.alias("y"), c.alias("confidence")))


@query("SELECT CAST(l AS BIGINT) AS length, CAST(unnest(list_distinct(list_concat(range(0, CAST(greatest(0, l - 100) AS BIGINT) + 1, 50), [CAST(greatest(0, l - 100) AS BIGINT)]))) AS BIGINT) AS start FROM range(60, 400, 30) t(l)")
def scan_tiles(spark, sf_dir):
    return spark.range(60, 400, 30).select(F.col("id").alias("length"), F.explode(scalars.tiles(F.col("id"), 100)).alias("start"))


# --- poses and transforms --------------------------------------------------------------------------

OFFSET = ("0.3 * cos(0.05 * CAST(sync_index AS DOUBLE)) + 0.2 * CAST(object_id AS DOUBLE)", "0.3 * sin(0.05 * CAST(sync_index AS DOUBLE))", "0.1 * CAST(object_id AS DOUBLE) - 0.3")


def _flat(spark, sf_dir) -> DataFrame:
    """Undistorted observations of flat objects with their place in the object."""
    obs = obs_of(spark, sf_dir)
    flat = events.world(obs).withColumn("z_coord", 0.1 * F.col("object_id").cast("double") - 0.3)
    seen = reconstruction.project(flat, cams_of(spark)).select(*IMAGE_KEY, "img_loc_x", "img_loc_y")
    rows = seen.join(obs.select(*IMAGE_KEY, "obj_loc_x", "obj_loc_y", "obj_loc_z"), IMAGE_KEY)
    return reconstruction.undistort(rows, cams_of(spark))


FULL = "full_views AS (SELECT cam_id, sync_index, object_id FROM obs GROUP BY ALL HAVING count(*) = 4)"


@query(f"""AND {FULL}, o AS (SELECT *, {OFFSET[0]} AS ax, {OFFSET[1]} AS ay, {OFFSET[2]} AS az FROM full_views JOIN cams USING (cam_id))
SELECT cam_id, sync_index, object_id, round(r0, 5) + 0 AS r0, round(r7, 5) + 0 AS r7, """ + ", ".join(f"round(r{3 * i} * ax + r{3 * i + 1} * ay + r{3 * i + 2} * az + t{i}, 5) + 0 AS t{i}" for i in range(3)) + ", CAST(4 AS BIGINT) AS n FROM o")
def object_poses(spark, sf_dir):
    p = poses.object_poses(_flat(spark, sf_dir))
    return rounded(p.select("cam_id", "sync_index", "object_id", F.col("r")[0].alias("r0"), F.col("r")[7].alias("r7"), *(F.col("t")[i].alias(f"t{i}") for i in range(3)), "n"), 5)


REL = "rel AS (SELECT a.cam_id AS cam_a, b.cam_id AS cam_b, " + ", ".join(
    f"{' + '.join(f'b.r{3 * i + k} * a.r{3 * j + k}' for k in range(3))} AS r{3 * i + j}" for i in range(3) for j in range(3)
) + ", a.t0 AS a0, a.t1 AS a1, a.t2 AS a2, b.t0 AS b0, b.t1 AS b1, b.t2 AS b2 FROM cams a JOIN cams b ON a.cam_id < b.cam_id)"
REL_OUT = ", ".join([f"round(r{i}, 5) + 0 AS r{i}" for i in range(9)] + [f"round(b{i} - (r{3 * i} * a0 + r{3 * i + 1} * a1 + r{3 * i + 2} * a2), 4) + 0 AS t{i}" for i in range(3)])


def _flat_columns(df: DataFrame) -> DataFrame:
    out = df.select(*(c for c in df.columns if c not in "rt"), *(F.col("r")[i].alias(f"r{i}") for i in range(9)), *(F.col("t")[i].alias(f"t{i}") for i in range(3)))
    return rounded(rounded(out, 5, *(f"r{i}" for i in range(9))), 4, *(f"t{i}" for i in range(3)))


@query(f"AND {FULL}, {REL} SELECT x.sync_index, x.object_id, cam_a, cam_b, {REL_OUT} FROM rel JOIN full_views x ON x.cam_id = cam_a JOIN full_views y ON y.cam_id = cam_b AND x.sync_index = y.sync_index AND x.object_id = y.object_id")
def relative_poses(spark, sf_dir):
    return _flat_columns(poses.relative_poses(poses.object_poses(_flat(spark, sf_dir)), cams_of(spark)))


@query(f"AND {FULL}, {REL}, c AS (SELECT x.cam_id AS cam_a, y.cam_id AS cam_b, count(*) AS n FROM full_views x JOIN full_views y USING (sync_index, object_id) WHERE x.cam_id < y.cam_id GROUP BY 1, 2) SELECT cam_a, cam_b, n, {REL_OUT} FROM rel JOIN c USING (cam_a, cam_b)")
def average_poses(spark, sf_dir):
    return _flat_columns(poses.average_poses(poses.relative_poses(poses.object_poses(_flat(spark, sf_dir)), cams_of(spark))))


@query(f"AND {FULL} SELECT a.cam_id AS cam_a, b.cam_id AS cam_b, count(*) AS n, CAST(0 AS DOUBLE) AS rmse FROM obs a JOIN obs b USING (sync_index, object_id, keypoint_id) SEMI JOIN (SELECT x.cam_id AS a_id, y.cam_id AS b_id FROM full_views x JOIN full_views y USING (sync_index, object_id)) v ON v.a_id = a.cam_id AND v.b_id = b.cam_id WHERE a.cam_id < b.cam_id GROUP BY 1, 2 HAVING count(*) >= 4")
def stereo_errors(spark, sf_dir):
    und = _flat(spark, sf_dir).withColumns({"img_loc_x": F.col("und_x"), "img_loc_y": F.col("und_y")})
    mean = poses.average_poses(poses.relative_poses(poses.object_poses(und), cams_of(spark)))
    e = poses.stereo_errors(coverage.pair_correspondences(und), mean)
    return rounded(e.select("cam_a", "cam_b", "n", "rmse"), 7)


@query("""AND r AS (SELECT DISTINCT sync_index, 0.001 * (sync_index % 7) + CASE WHEN sync_index % 41 = 5 THEN 0.5 ELSE 0 END AS th, 1 + 0.01 * (sync_index % 11) + CASE WHEN sync_index % 37 = 3 THEN 2 ELSE 0 END AS d FROM obs),
m AS (SELECT *, degrees(abs(th - (SELECT atan2(sum(sin(th)), sum(cos(th))) FROM r))) AS w FROM r), q AS (SELECT quantile_cont(d, 0.25) AS d1, quantile_cont(d, 0.75) AS d3, quantile_cont(w, 0.25) AS w1, quantile_cont(w, 0.75) AS w3, count(*) AS n FROM m)
SELECT sync_index FROM m, q WHERE n < 5 OR (d BETWEEN d1 - 1.5 * (d3 - d1) AND d3 + 1.5 * (d3 - d1) AND w <= w3 + 1.5 * (w3 - w1))""")
def usual_poses(spark, sf_dir):
    """Relative poses of two cameras without those that lie or turn far from the others."""
    s = obs_of(spark, sf_dir).select("sync_index").distinct()
    turn = 0.001 * (F.col("sync_index") % 7) + F.when(F.col("sync_index") % 41 == 5, 0.5).otherwise(0.0)
    d = 1 + 0.01 * (F.col("sync_index") % 11) + F.when(F.col("sync_index") % 37 == 3, 2.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    r = F.array(F.cos(turn), -F.sin(turn), zero, F.sin(turn), F.cos(turn), zero, zero, zero, one)
    relative = s.select(F.lit(0).cast("long").alias("cam_a"), F.lit(1).cast("long").alias("cam_b"), "sync_index", F.lit(0).cast("long").alias("object_id"), r.alias("r"), F.array(d, zero, zero).alias("t"))
    return poses.without_outlier_poses(relative).select("sync_index")


@query(f"""AND {FULL}, o AS (SELECT *, r6 * ({OFFSET[0]}) + r7 * ({OFFSET[1]}) + r8 * ({OFFSET[2]}) + t2 AS depth FROM full_views JOIN cams USING (cam_id))
SELECT cam_id, sync_index, object_id, round((atan2(r7, r6) + 2 * pi()) % (2 * pi()), 5) + 0 AS direction, round(0.05 * sqrt(r6 * r6 + r7 * r7) / depth, 6) + 0 AS magnitude FROM o""")
def board_tilts(spark, sf_dir):
    flat = _flat(spark, sf_dir).withColumns({"img_loc_x": F.col("und_x"), "img_loc_y": F.col("und_y")})
    found = poses.board_tilts(flat).select("cam_id", "sync_index", "object_id", "direction", "magnitude")
    # A direction just under the full turn is that of a camera that looks along the axis.
    near = F.when(F.col("direction") > 2 * poses.np.pi - 1e-7, 0.0).otherwise(F.col("direction"))
    return rounded(rounded(found.withColumn("direction", near), 5, "direction"), 6, "magnitude")

TURN = poses.Similarity(poses._turn(poses.np.array([0.1, -0.2, 0.3])), poses.np.array([1.0, -2.0, 0.5]), 1.5)


@query("SELECT " + ", ".join([f"round(CAST({float(TURN.r.reshape(-1)[i])!r} AS DOUBLE), 6) + 0 AS r{i}" for i in range(9)] + [f"round(CAST({float(TURN.t[i])!r} AS DOUBLE), 6) + 0 AS t{i}" for i in range(3)] + ["CAST(1.5 AS DOUBLE) AS scale"]))
def estimate_similarity(spark, sf_dir):
    w = events.world(obs_of(spark, sf_dir))
    moved = TURN.points(w).select(*WORLD_KEY, *(F.col(f"{c}_coord").alias(f"b{c}") for c in "xyz"))
    found = poses.estimate_similarity(w.join(moved, WORLD_KEY).select(*(F.col(f"{c}_coord").alias(f"a{c}") for c in "xyz"), "bx", "by", "bz"))
    row = {f"r{i}": float(found.r.reshape(-1)[i]) for i in range(9)} | {f"t{i}": float(found.t[i]) for i in range(3)} | {"scale": found.scale}
    return rounded(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row)))


@query("SELECT sync_index, object_id, keypoint_id, " + ", ".join(f"round(1.5 * ({' + '.join(f'({float(TURN.r[i, j])!r}) * {c}_coord' for j, c in enumerate('xyz'))}) + ({float(TURN.t[i])!r}), 6) + 0 AS {a}_coord" for i, a in enumerate("xyz")) + " FROM world")
def apply_similarity(spark, sf_dir):
    return rounded(TURN.points(events.world(obs_of(spark, sf_dir))).drop("frame_time"))


@query(f"AND {ALL_PROJ} SELECT sync_index, cam_id, object_id, keypoint_id, round(u, 5) + 0 AS img_loc_x, round(v, 5) + 0 AS img_loc_y FROM proj")
def projection_is_invariant(spark, sf_dir):
    moved = reconstruction.project(TURN.points(events.world(obs_of(spark, sf_dir))), TURN.cameras(cams_of(spark)))
    return rounded(moved.select(*IMAGE_KEY, "img_loc_x", "img_loc_y"), 5)


@query("SELECT cam_id, round(-(r0 * t0 + r3 * t1 + r6 * t2), 6) + 0 AS x, round(-(r1 * t0 + r4 * t1 + r7 * t2), 6) + 0 AS y, round(-(r2 * t0 + r5 * t1 + r8 * t2), 6) + 0 AS z FROM part_cams WHERE r0 IS NOT NULL AND NOT ignored")
def camera_centres(spark, sf_dir):
    return rounded(poses.posed_centres(cams_of(spark, True)))


# --- constraints and frame selection ---------------------------------------------------------------


@query("AND m AS (SELECT p_partkey AS o, CAST(p_partkey % 10 + 1 AS DOUBLE) / 100 AS side FROM part), c AS (SELECT o, side, CAST(i AS BIGINT) AS k, x * side AS x, y * side AS y FROM m, (VALUES (0, -0.5, 0.5), (1, 0.5, 0.5), (2, 0.5, -0.5), (3, -0.5, -0.5)) v(i, x, y)) SELECT a.o AS object_id_a, a.k AS keypoint_id_a, b.o AS object_id_b, b.k AS keypoint_id_b, round(sqrt(CAST((a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS DOUBLE)), 9) + 0 AS distance FROM c a JOIN c b ON a.o = b.o AND a.k < b.k")
def marker_constraints(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("object_id"), ((F.col("p_partkey") % 10 + 1).cast("double") / 100).alias("side"))
    return rounded(constraints.marker_constraints(p).drop("sigma"), 9)


@query("AND g AS (SELECT range AS p, range % 7 AS c, range // 7 AS r FROM range(35)), o AS (SELECT unnest([0, 6, 28, 34]) AS p), e AS (SELECT a.p AS a, b.p AS b FROM g a JOIN g b ON a.p < b.p AND abs(a.c - b.c) <= 1 AND abs(a.r - b.r) <= 1 UNION SELECT x.p, y.p FROM o x JOIN o y ON x.p < y.p) SELECT CAST(a AS BIGINT) AS keypoint_id_a, CAST(b AS BIGINT) AS keypoint_id_b, round(0.05 * sqrt((a % 7 - b % 7) ** 2 + (a // 7 - b // 7) ** 2), 9) + 0 AS distance FROM e")
def board_truss(spark, sf_dir):
    return rounded(constraints.board_truss(spark, 7, 5, 0.05).drop("sigma"), 9)


@query("SELECT CAST(1 AS BIGINT) AS object_id_from, CAST((1 + k) % 4 AS BIGINT) AS keypoint_id_from, CAST(2 AS BIGINT) AS object_id_to, CAST((6 - k) % 4 AS BIGINT) AS keypoint_id_to FROM range(4) t(k)")
def mirrored_corners(spark, sf_dir):
    return constraints.mirrored_corners(spark.createDataFrame([(1, 1, 2, 2)], "object_id_a long, corner_a long, object_id_b long, corner_b long"))


@query()
def select_frames(spark, sf_dir):
    obs = obs_of(spark, sf_dir)
    return selection.select_frames(obs, cams_of(spark), selection.frame_tilts(poses.board_tilts(obs)), target=30, least=4)


@query()
def smooth_points(spark, sf_dir):
    return rounded(trajectories.smooth(events.world(obs_of(spark, sf_dir)), cutoff=6.0, rate=30.0))


# --- adjustment ------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_points, true AS is_exact FROM (SELECT 1 FROM obs GROUP BY sync_index, object_id, keypoint_id HAVING count(*) >= 2)")
def bundle_adjust(spark, sf_dir):
    """Cameras 1 cm off, put right by the noise-free observations."""
    seen = _seen(spark, sf_dir)
    moved = cams_of(spark).withColumns({f"t{i}": F.col(f"t{i}") + 0.01 * ((F.col("cam_id") + i) % 3 - 1) * (F.col("cam_id") > 0).cast("int") for i in range(3)})
    found = bundle.adjust(seen, reconstruction.triangulate(seen, moved), moved, rounds=8)
    return found.world.agg(F.count("*").alias("n_points")).withColumn("is_exact", F.lit(found.rmse < 0.01))


@query("SELECT cam_id, round(fx, 2) + 0 AS fx, round(fy, 2) + 0 AS fy, round(k1, 4) + 0 AS k1, round(k2, 3) + 0 AS k2, CAST(0 AS DOUBLE) AS distance_rmse, (SELECT count(*) FROM (SELECT DISTINCT sync_index, object_id, keypoint_id FROM obs)) AS n_points FROM cams")
def bundle_lenses(spark, sf_dir):
    """Lenses 2 % and poses 5 mm off, put right by markers of a known side that turn and move with the events' frames."""
    markers = spark.createDataFrame([(0, 0.2), (1, 0.2)], "object_id long, side double")
    keys = obs_of(spark, sf_dir).select("sync_index", "object_id", "keypoint_id").distinct()
    s, o, x, y = F.col("sync_index"), F.col("object_id"), F.col("obj_loc_x"), F.col("obj_loc_y")
    a, b = 1.7 * s + o, 0.9 * F.sin(0.6 * s + o)
    spots = keys.join(F.broadcast(constraints.marker_corners(markers)), ["object_id", "keypoint_id"]).select(
        "sync_index", "object_id", "keypoint_id", (x * F.cos(a) - y * F.cos(b) * F.sin(a) + 0.35 * F.sin(1.3 * s + 2 * o)).alias("x_coord"),
        (x * F.sin(a) + y * F.cos(b) * F.cos(a) + 0.35 * F.cos(0.7 * s + o)).alias("y_coord"), (y * F.sin(b) + 0.5 + 0.25 * F.sin(2.1 * s + 3 * o)).alias("z_coord"),
    )
    seen = geometry.with_pixels(spots.crossJoin(F.broadcast(cams_of(spark)))).select("sync_index", "cam_id", "object_id", "keypoint_id", F.col("_u").alias("img_loc_x"), F.col("_v").alias("img_loc_y"), F.lit(None).cast("double").alias("frame_time"))
    off = cams_of(spark).withColumns({"fx": F.col("fx") * 1.02, "fy": F.col("fy") * 1.02, "k1": F.col("k1") + 0.01} | {f"t{i}": F.col(f"t{i}") + 0.005 * ((F.col("cam_id") + i) % 3 - 1) * (F.col("cam_id") > 0).cast("int") for i in range(3)})
    found = joint.adjust(seen, reconstruction.triangulate(seen, off), off, constraints.marker_constraints(markers), lenses=True)
    out = found.cameras.select("cam_id", *((F.round(c, n) + 0.0).alias(c) for c, n in (("fx", 2), ("fy", 2), ("k1", 4), ("k2", 3))), F.round(F.lit(found.distance_rmse), 6).alias("distance_rmse"))
    return out.crossJoin(F.broadcast(found.world.agg(F.count("*").alias("n_points"))))


@query(f"AND d AS (SELECT cam_id, r6 * x_coord + r7 * y_coord + r8 * z_coord + t2 AS z FROM world CROSS JOIN {POSED}) SELECT cam_id, round(quantile_cont(z, 0.95) / quantile_cont(z, 0.05), 6) + 0 AS depth_ratio, quantile_cont(z, 0.95) / quantile_cont(z, 0.05) >= 1.4 AS enough FROM d WHERE z > 0 GROUP BY cam_id")
def constrains_lenses(spark, sf_dir):
    return rounded(calibrate.constrains_lenses(events.world(obs_of(spark, sf_dir)), cams_of(spark, True), 1.4))


def _boards(spark, sf_dir) -> DataFrame:
    """A board of 5 x 4 corners before each camera in each of its frames, leaning as the frame's pixels say."""
    views = obs_of(spark, sf_dir).groupBy("cam_id", "sync_index").agg((F.avg("img_loc_x") + F.avg("img_loc_y")).alias("m"))
    m, sin, cos = F.col("m"), F.sin, F.cos
    (sx, cx), (sy, cy), (sz, cz) = ((sin(a), cos(a)) for a in (0.6 * sin(m), 0.5 * cos(1.7 * m), 0.3 * sin(3.1 * m)))
    turn = (cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)
    move = (0.25 * sin(2.3 * m), 0.15 * cos(1.3 * m), 0.6 + 0.3 * F.abs(sin(0.9 * m)))
    lenses = rig.cameras(spark, ROUND_RIG).select("cam_id", "fisheye", "fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")
    rows = views.withColumns({f"r{i}": e for i, e in enumerate(turn)} | {f"t{i}": e for i, e in enumerate(move)}).join(F.broadcast(lenses), "cam_id")
    rows = rows.withColumn("keypoint_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    rows = rows.withColumns({"x": 0.05 * (F.col("keypoint_id") % 5) - 0.1, "y": 0.05 * F.floor(F.col("keypoint_id") / 5) - 0.075, "z": F.lit(0.0)})
    return geometry.with_pixels(rows, "x", "y", "z").select(
        "sync_index", "cam_id", F.lit(0).cast("long").alias("object_id"), "keypoint_id", F.col("_u").alias("img_loc_x"), F.col("_v").alias("img_loc_y"),
        F.col("x").alias("obj_loc_x"), F.col("y").alias("obj_loc_y"), F.lit(None).cast("double").alias("obj_loc_z"),
    )


@query("SELECT cam_id, round(fx, 2) + 0 AS fx, round(fy, 2) + 0 AS fy, round(cx, 2) + 0 AS cx, round(cy, 2) + 0 AS cy, round(k1, 4) + 0 AS k1, round(k2, 4) + 0 AS k2, round(p1, 5) + 0 AS p1, round(p2, 5) + 0 AS p2, round(k3, 4) + 0 AS k3, true AS fits, (SELECT count(DISTINCT sync_index) FROM obs o WHERE o.cam_id = c.cam_id) AS n_frames FROM round_cams c")
def calibrated_lenses(spark, sf_dir):
    """The lenses of both kinds again, from boards that were seen through them."""
    found = intrinsics.calibrate(_boards(spark, sf_dir), rig.cameras(spark, ROUND_RIG))
    digits = {"fx": 2, "fy": 2, "cx": 2, "cy": 2, "k1": 4, "k2": 4, "p1": 5, "p2": 5, "k3": 4}
    return found.select("cam_id", *(((F.round(c, n)) + 0.0).alias(c) for c, n in digits.items()), (F.col("rmse") < 1e-4).alias("fits"), "n_frames")


@query("""AND c0 AS (SELECT * FROM cams WHERE cam_id = 0), j AS (SELECT c.cam_id, [[c.r0, c.r1, c.r2], [c.r3, c.r4, c.r5], [c.r6, c.r7, c.r8]] AS r, [c.t0, c.t1, c.t2] AS t,
[[z.r0, z.r1, z.r2], [z.r3, z.r4, z.r5], [z.r6, z.r7, z.r8]] AS r0, [z.t0, z.t1, z.t2] AS t0 FROM cams c, c0 z),
m AS (SELECT cam_id, t, t0, [[list_dot_product(r[i], r0[k]) FOR k IN [1, 2, 3]] FOR i IN [1, 2, 3]] AS q FROM j), n AS (SELECT cam_id, q, [t[i] - list_dot_product(q[i], t0) FOR i IN [1, 2, 3]] AS d FROM m),
s AS (SELECT sqrt(list_dot_product(d, d)) AS size FROM n WHERE cam_id = 1)
SELECT cam_id, round(q[1][1], 3) + 0 AS r00, round(q[1][3], 3) + 0 AS r02, round(q[3][1], 3) + 0 AS r20, round(d[1] / size, 3) + 0 AS x, round(d[2] / size, 3) + 0 AS y, round(d[3] / size, 3) + 0 AS z FROM n, s""")
def epipolar_rig(spark, sf_dir):
    """The rig again, before its first camera and at baseline 1 to its second, from points of the events that all cameras see."""
    import numpy as np

    obs = obs_of(spark, sf_dir)
    spots = obs.groupBy("sync_index", "object_id", "keypoint_id").agg(F.min("img_loc_x").alias("a"), F.max("img_loc_y").alias("b"), F.sum("img_loc_x").alias("c"))
    spots = spots.select("sync_index", "object_id", "keypoint_id", (0.4 * F.sin("a")).alias("x_coord"), (0.4 * F.sin(1.3 * F.col("b"))).alias("y_coord"), (0.5 + 0.4 * F.sin(0.7 * F.col("c"))).alias("z_coord"))
    seen = geometry.with_pixels(spots.crossJoin(F.broadcast(cams_of(spark))))
    points = seen.select("sync_index", "cam_id", "object_id", "keypoint_id", F.col("_u").alias("img_loc_x"), F.col("_v").alias("img_loc_y"))
    poses = epipolar.bootstrap(points, intrinsics.without_poses(cams_of(spark))).before(0)
    size = float(np.linalg.norm(poses[1][1]))
    rows = [(c, float(r[0, 0]), float(r[0, 2]), float(r[2, 0]), *(float(v) / size for v in t)) for c, (r, t) in poses.items()]
    return rounded(spark.createDataFrame(rows, "cam_id long, r00 double, r02 double, r20 double, x double, y double, z double"), 3)


@query("SELECT cam_id, width / 2.0 AS fx, width / 2.0 AS fy, width / 2.0 AS cx, height / 2.0 AS cy, CAST(0 AS DOUBLE) AS k1, CAST(0 AS DOUBLE) AS k3 FROM cams")
def default_lenses(spark, sf_dir):
    return intrinsics.default_lenses(intrinsics.without_lenses(cams_of(spark))).select("cam_id", "fx", "fy", "cx", "cy", "k1", "k3")


# --- targets ---------------------------------------------------------------------------------------

BOARDS_SQL = "b AS (SELECT p_partkey AS board_id, p_size % 5 + 2 AS c, p_size % 4 + 2 AS r FROM part), k AS (SELECT board_id, c, r, unnest(range(c * r)) AS a FROM b)"


def _boards_of(spark, sf_dir, columns="p_size % 5 + 2", rows="p_size % 4 + 2") -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("board_id"), F.expr(columns).alias("columns"), F.expr(rows).alias("rows"), F.expr("'DICT_' || CASE p_partkey % 5 WHEN 0 THEN '4X4' WHEN 1 THEN '5X5' WHEN 2 THEN '6X6' WHEN 3 THEN '7X7' ELSE 'OWN' END").alias("family"))


@query(f"AND {BOARDS_SQL} SELECT board_id, a AS keypoint_id_a, a + 1 AS keypoint_id_b FROM k WHERE a % c < c - 1 UNION ALL SELECT board_id, a, a + c FROM k WHERE a < c * (r - 1)")
def chessboard_edges(spark, sf_dir):
    return targets.chessboard_edges(_boards_of(spark, sf_dir))


@query(f"AND {BOARDS_SQL} SELECT p.board_id, p.a AS keypoint_id_a, q.a AS keypoint_id_b FROM k p JOIN k q ON p.board_id = q.board_id AND p.a < q.a AND (p.a % p.c = q.a % q.c OR p.a // p.c = q.a // q.c)")
def board_line_edges(spark, sf_dir):
    k = _boards_of(spark, sf_dir).withColumn("keypoint_id", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("columns") * F.col("rows") - 1).cast("long"))))
    return targets.line_edges(k.select("board_id", "keypoint_id", (0.05 * (F.col("keypoint_id") % F.col("columns"))).alias("obj_loc_x"), (0.05 * F.expr("keypoint_id div columns")).alias("obj_loc_y")))


@query("""SELECT board_id, n_markers, CASE WHEN family <> 'OWN' AND n_markers <= 1000 THEN 'DICT_' || family || '_' || CASE WHEN n_markers <= 50 THEN 50 WHEN n_markers <= 100 THEN 100 WHEN n_markers <= 250 THEN 250 ELSE 1000 END END AS dictionary
FROM (SELECT p_partkey AS board_id, (p_size + 2) * (p_size + 1) // 2 AS n_markers, CASE p_partkey % 5 WHEN 0 THEN '4X4' WHEN 1 THEN '5X5' WHEN 2 THEN '6X6' WHEN 3 THEN '7X7' ELSE 'OWN' END AS family FROM part)""")
def fitting_pools(spark, sf_dir):
    return targets.fitting_pools(_boards_of(spark, sf_dir, "p_size + 2", "p_size + 1"), targets.pools(spark))


def _markers_of(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("object_id"), (0.05 * (F.col("p_size") % 4)).alias("side"), (F.col("p_partkey") % 3 == 0).alias("static"))


@query("""AND m AS (SELECT p_partkey AS id, p_size % 4 AS side, p_partkey % 3 = 0 AS static FROM part),
l AS (SELECT l_partkey AS a, CASE WHEN l_linenumber < 7 THEN l_linenumber % 6 END AS ca, l_suppkey AS b, l_linenumber % 3 AS cb, l_quantity - 3 AS d, least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem),
p AS (SELECT o_custkey AS a, 0 AS ca, o_orderkey AS b, 0 AS cb, o_orderkey % 3 AS t, least(o_custkey, o_orderkey) AS low, greatest(o_custkey, o_orderkey) AS high FROM orders),
le AS (SELECT a AS id FROM l UNION ALL SELECT b FROM l), pe AS (SELECT a AS id FROM p UNION ALL SELECT b FROM p WHERE a <> b),
e AS (SELECT CASE WHEN a < b OR (a = b AND ca < cb) THEN (a, ca, b, cb) ELSE (b, cb, a, ca) END AS e, low, high FROM l WHERE ca IS NOT NULL UNION ALL SELECT CASE WHEN a < b OR a = b THEN (a, -1, b, cb) ELSE (b, cb, a, -1) END, low, high FROM l WHERE ca IS NULL)
SELECT DISTINCT * FROM (SELECT 'bad side' AS problem, id AS object_id, CAST(NULL AS BIGINT) AS other FROM m WHERE side = 0 UNION ALL SELECT 'beyond the dictionary', id, NULL FROM m WHERE id >= 1000 OR id < 0
UNION ALL SELECT 'unknown marker in a link', id, NULL FROM le WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT 'unknown marker in a pair', id, NULL FROM pe WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'link of one marker', a, NULL FROM l WHERE a = b UNION ALL SELECT 'pair of one marker', a, NULL FROM p WHERE a = b
UNION ALL SELECT 'bad corner of a link', low, high FROM l WHERE ca > 3 UNION ALL SELECT 'link with one corner', low, high FROM l WHERE ca IS NULL
UNION ALL SELECT 'static and mobile link', low, high FROM l JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.static <> y.static
UNION ALL SELECT 'static and mobile pair', low, high FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.static <> y.static
UNION ALL SELECT 'unequal sides of a pair', low, high FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE x.side <> y.side
UNION ALL SELECT 'bad distance', low, high FROM l WHERE d <= 0 UNION ALL SELECT 'repeated link', min(low), min(high) FROM e GROUP BY e HAVING count(*) > 1
UNION ALL SELECT 'several mirror pairs', id, NULL FROM pe GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'link and pair', l.low, l.high FROM l JOIN p ON l.low = p.low AND l.high = p.high
UNION ALL SELECT 'link to a remapped face', id, NULL FROM le WHERE id IN (SELECT b FROM p WHERE t = 0))""")
def target_problems(spark, sf_dir):
    line, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
    links = line.select(
        F.col("l_partkey").alias("object_id_a"), F.when(F.col("l_linenumber") < 7, (F.col("l_linenumber") % 6).cast("int")).alias("corner_a"), F.col("l_suppkey").alias("object_id_b"), (F.col("l_linenumber") % 3).cast("int").alias("corner_b"),
        (F.col("l_quantity") - 3).cast("double").alias("distance"), F.lit(None).cast("double").alias("sigma"),
    )
    pairs = orders.select(F.col("o_custkey").alias("object_id_a"), F.lit(0).alias("corner_a"), F.col("o_orderkey").alias("object_id_b"), F.lit(0).alias("corner_b"), (0.01 * (F.col("o_orderkey") % 3)).alias("thickness"), F.lit(None).cast("double").alias("sigma"))
    return targets.problems(_markers_of(spark, sf_dir), links, pairs, 1000)


@query("""SELECT sync_index, cam_id, object_id, keypoint_id, CAST(s * CASE WHEN keypoint_id IN (0, 3) THEN -0.025 ELSE 0.025 END AS DOUBLE) + 0 AS obj_loc_x, CAST(s * CASE WHEN keypoint_id < 2 THEN 0.025 ELSE -0.025 END AS DOUBLE) + 0 AS obj_loc_y, CAST(CASE WHEN s IS NOT NULL THEN CASE WHEN object_id % 2 = 0 THEN 0.01 ELSE 0.0 END END AS DOUBLE) AS obj_loc_z
FROM (SELECT sync_index, cam_id, sync_index % 300 AS object_id, keypoint_id FROM obs) LEFT JOIN (SELECT p_partkey AS object_id, p_size % 4 AS s FROM part) USING (object_id)""")
def placed_detections(spark, sf_dir):
    """Detections of many markers, some of which no target has; every second one is the back of a board."""
    markers = _markers_of(spark, sf_dir)
    back = markers.filter("object_id % 2 = 0").select("object_id", F.lit(0.01).alias("thickness"))
    points = obs_of(spark, sf_dir).withColumn("object_id", F.col("sync_index") % 300)
    return rounded(targets.placed(points, markers, back).select("sync_index", "cam_id", "object_id", "keypoint_id", "obj_loc_x", "obj_loc_y", "obj_loc_z"))


# --- playback and detections -----------------------------------------------------------------------


@query("""AND w AS (SELECT sync_index, object_id, keypoint_id, x_coord FROM world WHERE object_id <> 1 UNION ALL SELECT -1, object_id, keypoint_id, arg_min(x_coord, sync_index) FROM world WHERE object_id = 1 GROUP BY ALL),
p AS (SELECT object_id, keypoint_id, row_number() OVER (ORDER BY object_id, keypoint_id) - 1 AS place FROM (SELECT DISTINCT object_id, keypoint_id FROM w))
SELECT f.sync_index, p.object_id, p.keypoint_id, place, round(coalesce(s.x_coord, m.x_coord), 6) + 0 AS x_coord FROM (SELECT DISTINCT sync_index FROM w WHERE sync_index <> -1) f CROSS JOIN p
LEFT JOIN w m ON m.sync_index = f.sync_index AND m.object_id = p.object_id AND m.keypoint_id = p.keypoint_id LEFT JOIN w s ON s.sync_index = -1 AND s.object_id = p.object_id AND s.keypoint_id = p.keypoint_id""")
def playback_frames(spark, sf_dir):
    every = events.world(obs_of(spark, sf_dir))
    # A static point has one place: where it was first.
    place = every.filter("object_id = 1").groupBy("object_id", "keypoint_id").agg(*(F.min_by(c, "sync_index").alias(c) for c in ("x_coord", "y_coord", "z_coord")))
    w = every.filter("object_id <> 1").drop("frame_time").unionByName(place.withColumn("sync_index", F.lit(-1).cast("long")))
    return rounded(playback.playback(w).select(*WORLD_KEY, F.col("place").cast("long").alias("place"), "x_coord"))


@query("AND f AS (SELECT sync_index, row_number() OVER (ORDER BY sync_index) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT sync_index FROM obs)) SELECT sync_index FROM f WHERE i IN (SELECT CAST(round_even(k * ((SELECT max(n) FROM f) - 1) / 11.0, 0) AS BIGINT) FROM range(12) t(k))")
def evenly_spaced_frames(spark, sf_dir):
    return playback.evenly_spaced(obs_of(spark, sf_dir), 12)


@query("""AND d AS (SELECT cam_id, sync_index, img_loc_x AS x, img_loc_y AS y, CAST((keypoint_id * 3 + sync_index) % 10 AS DOUBLE) / 10 AS confidence FROM obs),
b AS (SELECT cam_id, sync_index, min(x) FILTER (WHERE confidence >= 0.5) AS x0, max(x) FILTER (WHERE confidence >= 0.5) AS x9, min(y) FILTER (WHERE confidence >= 0.5) AS y0, max(y) FILTER (WHERE confidence >= 0.5) AS y9 FROM d GROUP BY 1, 2),
c AS (SELECT *, (x9 - x0) * 1.6 AS w, (y9 - y0) * 1.6 AS h, (x0 + x9) / 2 AS cx, (y0 + y9) / 2 AS cy FROM b), e AS (SELECT *, CASE WHEN w / greatest(h, 1) > 0.75 THEN w ELSE h * 0.75 END AS bw, CASE WHEN w / greatest(h, 1) > 0.75 THEN w / 0.75 ELSE h END AS bh FROM c),
g AS (SELECT *, CAST(trunc(greatest(0, cx - bw / 2)) AS BIGINT) AS x1, CAST(trunc(greatest(0, cy - bh / 2)) AS BIGINT) AS y1, CAST(trunc(least(1920, cx + bw / 2)) AS BIGINT) AS x2, CAST(trunc(least(1080, cy + bh / 2)) AS BIGINT) AS y2 FROM e)
SELECT cam_id, sync_index, CASE WHEN x0 IS NULL THEN 0 ELSE x1 END AS x1, CASE WHEN x0 IS NULL THEN 0 ELSE y1 END AS y1, CASE WHEN x0 IS NULL THEN 1920 WHEN x2 <= x1 THEN least(x1 + 1, 1920) ELSE x2 END AS x2, CASE WHEN x0 IS NULL THEN 1080 WHEN y2 <= y1 THEN least(y1 + 1, 1080) ELSE y2 END AS y2 FROM g""")
def padded_boxes(spark, sf_dir):
    d = obs_of(spark, sf_dir).select("cam_id", "sync_index", F.col("img_loc_x").alias("x"), F.col("img_loc_y").alias("y"), (((F.col("keypoint_id") * 3 + F.col("sync_index")) % 10).cast("double") / 10).alias("confidence"))
    return playback.padded_boxes(d, ("cam_id", "sync_index"), 0.5, 0.75, 1920, 1080)


@query("""AND h AS (SELECT event_id, [CAST((event_id * 7 + i * i * 13) % 37 AS DOUBLE) / 37 FOR i IN range(30)] AS m FROM events), t AS (SELECT *, list_position(m, list_max(m)) - 1 AS p FROM h), q AS (SELECT *, p % 6 AS i, p // 6 AS j FROM t),
r AS (SELECT *, CASE WHEN i > 0 AND i < 5 THEN m[p] END AS xa, CASE WHEN i > 0 AND i < 5 THEN m[p + 2] END AS xb, CASE WHEN j > 0 AND j < 4 THEN m[p - 5] END AS ya, CASE WHEN j > 0 AND j < 4 THEN m[p + 7] END AS yb, m[p + 1] AS c FROM q)
SELECT event_id, round(i + CASE WHEN xa IS NULL OR abs(xa - 2 * c + xb) < 1e-12 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (xa - xb) / (xa - 2 * c + xb))) END, 6) + 0 AS x,
round(j + CASE WHEN ya IS NULL OR abs(ya - 2 * c + yb) < 1e-12 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (ya - yb) / (ya - 2 * c + yb))) END, 6) + 0 AS y, round(greatest(0, least(1, c)), 6) + 0 AS confidence FROM r""")
def decode_heatmaps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    heat = e.withColumn("heat", F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: ((F.col("event_id") * 7 + i * i * 13) % 37).cast("double") / 37))
    x, y, c = scalars.decode_heatmap(F.col("heat"), 6, 5)
    return rounded(heat.select("event_id", x.alias("x"), y.alias("y"), c.alias("confidence")))
