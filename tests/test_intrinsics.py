"""Lenses from boards."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import intrinsics
from sightline.operators.poses import _turns
from sightline.sources import rig

POINTS = "sync_index long, cam_id long, object_id long, keypoint_id long, img_loc_x double, img_loc_y double, obj_loc_x double, obj_loc_y double, obj_loc_z double"


def boards(spark, rng, views=25, noise=0.0, fisheye=False, leaning=0.5):
    lens = np.array([(rig.FISHEYE if fisheye else rig.LENS)[k] for k in intrinsics.LENS])
    corners = np.array([(0.05 * (k % 6) - 0.125, 0.05 * (k // 6) - 0.1, 0.0) for k in range(30)])
    rows = []
    for i in range(views):
        r = _turns(rng.uniform(-leaning, leaning, (1, 3)) if leaning else np.zeros((1, 3)))[0]
        t = np.array([rng.uniform(-0.2, 0.2), rng.uniform(-0.12, 0.12), rng.uniform(0.4, 0.9)])
        uv = intrinsics.project(lens, fisheye, corners @ r.T + t) + rng.normal(0, noise, (30, 2))
        seen = rng.permutation(30)[: rng.integers(20, 31)]
        rows += [(i, 0, 0, int(k), float(uv[k, 0]), float(uv[k, 1]), float(corners[k, 0]), float(corners[k, 1]), None if i % 2 else float("nan")) for k in seen]
        rows += [(1000 + i, 0, 0, 0, 5.0, 5.0, 0.0, 0.0, None)] * 1  # a view of one corner
    camera = rig.cameras(spark, rig.ring(1, fisheye=(0,) if fisheye else ()))
    return spark.createDataFrame(rows, POINTS).repartition(3), intrinsics.without_lenses(camera), lens


@pytest.mark.parametrize("fisheye", [False, True])
def test_lens_from_boards(spark, fisheye):
    points, camera, lens = boards(spark, np.random.default_rng(1), fisheye=fisheye)
    (row,) = intrinsics.calibrate(points, camera).collect()
    assert [row[k] for k in intrinsics.LENS] == pytest.approx(lens, rel=1e-4, abs=1e-5) and row["rmse"] < 1e-5 and row["n_frames"] == 25


def test_lens_from_noisy_boards(spark):
    points, camera, lens = boards(spark, np.random.default_rng(2), noise=0.5)
    (row,) = intrinsics.calibrate(points, camera).collect()
    assert abs(row["fx"] / lens[0] - 1) < 0.005 and abs(row["fy"] / lens[1] - 1) < 0.005
    assert 0.5 < row["rmse"] < 0.8


def test_selected_views_and_failures(spark):
    points, camera, lens = boards(spark, np.random.default_rng(3))
    frames = spark.createDataFrame([(0, i) for i in (1, 3, 5, 7, 9, 11, 13, 15)], "cam_id long, sync_index long")
    (row,) = intrinsics.calibrate(points, camera, frames).collect()
    assert row["n_frames"] == 8 and abs(row["fx"] / lens[0] - 1) < 1e-3
    assert intrinsics.calibrate(points.filter("sync_index = 0"), camera).collect() == []
    assert intrinsics.calibrate(points.limit(0), camera).collect() == []
    views = intrinsics.calibration_views(points, frames).collect()
    assert {r["sync_index"] for r in views} == {1, 3, 5, 7, 9, 11, 13, 15} and all(len(r["v"]) == 5 * r["n"] for r in views)


def test_boards_that_never_lean_fall_back(spark):
    """Parallel boards don't fix the focal length: the closed form gives way to the guess, and nothing fails."""
    points, camera, _ = boards(spark, np.random.default_rng(4), leaning=0.0)
    (row,) = intrinsics.calibrate(points, camera, rounds=5).collect()
    assert np.isfinite([row[k] for k in intrinsics.LENS]).all()
    assert intrinsics.closed_form(np.zeros((5, 5)), 1920, 1080) is None


def test_default_lenses(spark):
    cameras = rig.cameras(spark, rig.ring(2))
    assert [r["fx"] for r in intrinsics.default_lenses(cameras).collect()] == [960.0, 960.0]
    for bad in (rig.cameras(spark, rig.ring(2, fisheye=(1,))), cameras.withColumn("width", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            intrinsics.default_lenses(bad)
    assert intrinsics.without_poses(cameras).filter("r0 is not null or t2 is not null").count() == 0


def test_inverses_of_nearly_singular_matrices_are_pseudo_inverses():
    import numpy as np

    from sightline.operators.intrinsics import _inverse

    rng = np.random.default_rng(2)
    j = rng.normal(size=(6, 9, 6))
    j[3, :, 5] = j[3, :, 4]
    j[4] = 0.0
    a = np.einsum("gni,gnj->gij", j, j)
    assert np.allclose(_inverse(a), np.linalg.pinv(a, hermitian=True), rtol=1e-6, atol=1e-9)
