"""Bundle adjustment on scenes whose answer is known."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sightline import schema
from sightline.operators import bundle, calibrate, poses, reconstruction
from sightline.sources import rig


def test_adjust_recovers_a_scene(spark):
    rng = np.random.default_rng(1)
    truth = rig.ring(4)
    cams = rig.cameras(spark, truth)
    grid = [(s, 0, k, float(0.3 * np.cos(s) + 0.1 * (k % 3)), float(0.3 * np.sin(s) + 0.1 * (k // 3)), 0.3 + 0.05 * ((s + k) % 5)) for s in range(12) for k in range(6)] + [(-1, 9, k, 0.2 * k - 0.3, 0.1 * k, 0.2) for k in range(4)]
    world = spark.createDataFrame(grid, "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double")
    seen = reconstruction.project(world, cams)
    static = seen.filter("sync_index = -1").withColumn("sync_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    obs = seen.filter("sync_index >= 0").unionByName(static).withColumn("frame_time", F.lit(None).cast("double"))
    off = []
    for i, c in enumerate(truth):
        turn = poses._turn(rng.normal(0, 0.01, 3) * (i > 0)) @ np.array([c[f"r{k}"] for k in range(9)]).reshape(3, 3)
        off.append({**c, **{f"r{k}": float(v) for k, v in enumerate(turn.reshape(-1))}, **{f"t{k}": c[f"t{k}"] + float(rng.normal(0, 0.01)) * (i > 0) for k in range(3)}})
    start = rig.cameras(spark, off)
    points = reconstruction.triangulate(obs, start, static_objects=[9])
    out = bundle.adjust(obs, points, start, static_objects=[9], rounds=12)
    assert out.rmse_before > 1 and out.rmse < 1e-3
    # The scene is known up to a similarity, which leaves distances' ratios: align and compare.
    pairs = out.world.join(world.select(*schema.WORLD_KEY, *(F.col(f"{c}_coord").alias(f"b{c}") for c in "xyz")), list(schema.WORLD_KEY)).select(*(F.col(f"{c}_coord").alias(f"a{c}") for c in "xyz"), "bx", "by", "bz")
    fit = poses.estimate_similarity(pairs)
    rows = np.array([tuple(r) for r in pairs.collect()])
    assert len(rows) == 76 and np.abs(fit.scale * rows[:, :3] @ fit.r.T + fit.t - rows[:, 3:]).max() < 1e-4
    assert out.cameras.columns == cams.columns


def test_calibrate_from_nothing(spark):
    """A tilted board that circles before four cameras: relative poses come out, the anchor is the origin."""
    truth = rig.ring(4)
    grid = []
    for s in range(10):
        turn = poses._turn(np.array([0.3 * np.sin(s), 0.4 * np.cos(s), 0.2 * s]))
        for k in range(12):
            place = np.array([0.05 * (k % 4), 0.05 * (k // 4), 0.0])
            x = turn @ place + np.array([0.2 * np.cos(s), 0.2 * np.sin(s), 0.1])
            grid.append((s, 0, k, *map(float, x), *map(float, place)))
    world = spark.createDataFrame(grid, "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double, obj_loc_x double, obj_loc_y double, obj_loc_z double")
    cams = rig.cameras(spark, truth)
    seen = reconstruction.project(world, cams).drop("width", "height", "depth")
    obs = seen.join(world.select(*schema.WORLD_KEY, "obj_loc_x", "obj_loc_y", "obj_loc_z"), list(schema.WORLD_KEY)).withColumn("frame_time", F.lit(None).cast("double"))
    blind = cams.withColumns({c: F.lit(None).cast("double") for c in (*(f"r{i}" for i in range(9)), "t0", "t1", "t2")})
    out = calibrate.calibrate(obs, blind, rounds=4)
    assert out.rmse < 0.01
    found = {r["cam_id"]: (np.array([r[f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([r[f"t{i}"] for i in range(3)])) for r in out.cameras.collect()}
    want = {c["cam_id"]: (np.array([c[f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([c[f"t{i}"] for i in range(3)])) for c in truth}
    for b in range(4):
        a = out.anchor
        r = want[b][0] @ want[a][0].T
        assert np.allclose(found[b][0], r, atol=1e-4) and np.allclose(found[b][1], want[b][1] - r @ want[a][1], atol=1e-3)


def test_points_between_opposite_cameras_hold_nobody_up(spark):
    """Points that two opposite cameras alone see, almost on the line between them: depths that are hardly fixed."""
    truth = rig.ring(4)
    cams = rig.cameras(spark, truth)
    grid = [(s, 0, k, float(0.3 * np.cos(s) + 0.1 * (k % 3)), float(0.3 * np.sin(s) + 0.1 * (k // 3)), 0.3 + 0.05 * ((s + k) % 5)) for s in range(6) for k in range(6)]
    grid += [(s, 1, s, 0.1 * s - 0.5, 3e-5 * (s + 1), 0.5) for s in range(12)]
    seen = reconstruction.project(spark.createDataFrame(grid, "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double"), cams)
    obs = seen.filter("object_id = 0 or cam_id in (0, 2)").withColumn("frame_time", F.lit(None).cast("double"))
    off = cams.withColumns({f"t{i}": F.col(f"t{i}") + 0.01 * ((F.col("cam_id") + i) % 3 - 1) * (F.col("cam_id") > 0).cast("int") for i in range(3)})
    out = bundle.adjust(obs, reconstruction.triangulate(obs, off), off, rounds=8)
    assert out.rmse_before > 1 and out.rmse < 0.01 and out.world.count() == 48
