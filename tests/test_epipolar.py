"""Rigs from matching points alone."""

from __future__ import annotations

import numpy as np
import pytest

from sightline.operators import epipolar
from sightline.sources import rig

POINTS = "sync_index long, cam_id long, object_id long, keypoint_id long, img_loc_x double, img_loc_y double"
ROWS = rig.ring(5, ignored=(4,))


def scene(spark, seed=0, frames=60, outliers=0.0, noise=0.0, flat=False, cams=(0, 1, 2, 3, 4), dropped=0.0):
    from sightline.operators.intrinsics import LENS, project

    rng = np.random.default_rng(seed)
    rows = []
    for cam in cams:
        own = ROWS[cam]
        r, t = np.array([own[f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([own[f"t{i}"] for i in range(3)])
        lens = np.array([own[k] for k in LENS])
        points = np.random.default_rng(99)
        for i in range(frames):
            x = points.uniform(-0.4, 0.4, (4, 3)) + [0, 0, 0.5]
            if flat:
                x[:, 2] = 0.5
            uv = project(lens, False, x @ r.T + t) + rng.normal(0, noise, (4, 2))
            wrong = rng.random(4) < outliers
            uv[wrong] += rng.uniform(-300, 300, (wrong.sum(), 2))
            rows += [(i, cam, 0, k, *map(float, uv[k])) for k in range(4) if rng.random() >= dropped]
    rows.append((0, 0, 9, 9, None, None))
    return spark.createDataFrame(rows, POINTS).repartition(4)


def check(found, degrees, cams=(0, 1, 2, 3)):
    assert set(found.poses) == set(cams)
    poses = found.before(0)
    true = {c: (np.array([ROWS[c][f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([ROWS[c][f"t{i}"] for i in range(3)])) for c in cams}
    scale = None
    for c in cams[1:]:
        r = true[c][0] @ true[0][0].T
        t = true[c][1] - r @ true[0][1]
        angle = np.degrees(np.arccos(np.clip((np.trace(poses[c][0] @ r.T) - 1) / 2, -1, 1)))
        scale = scale or np.linalg.norm(t) / np.linalg.norm(poses[c][1])
        assert angle < degrees and np.linalg.norm(poses[c][1] * scale - t) < np.radians(degrees) * 6


def test_exact_points(spark):
    found = epipolar.bootstrap(scene(spark), rig.cameras(spark, ROWS))
    check(found, 0.01)
    assert found.failures == 0 and found.worst_error < 1e-6 and all(p.inliers == p.matches == p.before_both for p in found.pairs.values())
    assert len(found.pairs) == 6 and all(p.conditioning > 0.9 for p in found.pairs.values())


def test_outliers_noise_and_gaps(spark):
    found = epipolar.bootstrap(scene(spark, 1, frames=120, outliers=0.2, noise=0.3, dropped=0.2), rig.cameras(spark, ROWS))
    check(found, 0.5)
    assert all(0.4 < p.inliers / p.matches < 0.9 for p in found.pairs.values()), {k: (p.inliers, p.matches, p.before_both) for k, p in found.pairs.items()}


def test_two_cameras(spark):
    found = epipolar.bootstrap(scene(spark, 2, cams=(0, 1)), rig.cameras(spark, ROWS))
    check(found, 0.01, (0, 1))
    assert found.worst_error == 0.0


def test_failures(spark):
    cameras = rig.cameras(spark, ROWS)
    for points in (scene(spark, 3, cams=(0,)), scene(spark, 3, cams=(0, 4)), scene(spark, 3, frames=1, cams=(0, 1)), scene(spark, 3).limit(0)):
        with pytest.raises(ValueError):
            epipolar.bootstrap(points, cameras)
    # Too few points for a third camera: it is left out and counts as a failure.
    few = scene(spark, 4, cams=(0, 1)).unionByName(scene(spark, 4, frames=8, cams=(2,)))
    found = epipolar.bootstrap(few, cameras)
    assert found.failures >= 1 and {0, 1} <= set(found.poses)


def test_flat_points_are_badly_conditioned(spark):
    pairs = epipolar.pair_poses(epipolar.matches(scene(spark, 5, flat=True, noise=0.2), rig.cameras(spark, ROWS)), {c: 1301.37 for c in range(5)})
    good = epipolar.pair_poses(epipolar.matches(scene(spark, 5, noise=0.2), rig.cameras(spark, ROWS)), {c: 1301.37 for c in range(5)})
    assert min(p.conditioning for p in pairs.values()) < 0.9 < min(p.conditioning for p in good.values())
    assert epipolar.conditioning(np.diag([1.0, 1.0, 0.0])) == 1.0 and epipolar.conditioning(np.zeros((3, 3))) == 0.0


def test_votes_are_those_of_the_distances():
    """Products of matrices, in blocks smaller than the matches, count what the distances count."""
    rng = np.random.default_rng(5)
    e, m = epipolar._constrained(rng.normal(size=(500, 3, 3))), rng.normal(size=(1500, 4))
    assert (epipolar.agreeing(e, m, 0.05) == (epipolar.sampson(e, m) <= 0.05).sum(axis=1)).all()
    poses, x = rng.normal(size=(300, 3, 4)), rng.normal(size=(2000, 5))
    assert (epipolar._close(poses, x, 0.3) == (epipolar._off(poses, x) <= 0.3).sum(axis=1)).all()
    r, t, points = epipolar._turns(np.array([[0.1, 0.7, -0.2]]))[0], np.array([-0.8, 0.1, 0.3]), rng.normal(size=(500, 3)) * 4
    far = points @ r.T + t
    m = np.column_stack([points[:, :2] / points[:, 2:], far[:, :2] / far[:, 2:]])
    assert (epipolar.before_both(m, r, t) == epipolar.intersect(m, r, t)[1]).all()
