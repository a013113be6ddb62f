"""The scene file against one made by hand."""

from __future__ import annotations

import json

import numpy as np
import pytest

from sightline.operators import trajectories
from sightline.sources import rig, scenes

WORLD = "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double"


def test_scene(spark, tmp_path):
    rows = [(9, 5, 3, 0.1234567, 2.0, 3.0), (9, 5, 1, 1.0, 1.0, 1.0), (4, 5, 3, 7.0, -0.0000001, 9.0), (12, 5, 7, 0.5, 0.5, 0.5), (12, 5, 1, None, 1.0, 1.0), (-1, 5, 8, 1.0, 1.0, 1.0), (10, 2, 1, 4.0, 4.0, 4.0)]
    world, cams = spark.createDataFrame(rows, WORLD), rig.cameras(spark, rig.ring(3, ignored=(1,)))
    path = str(tmp_path / "scene.json")
    scenes.write_scene(world, cams, path, 30, [("r", "hand", "arm"), ("g", "arm", "foot"), ("b", "arm", "nobody")], {"hand": 3, "arm": 1, "foot": 99}, {"r": (1.0, 0.0, 0.0)}, {2: "/v.mp4"})
    got = json.loads((tmp_path / "scene.json").read_text())
    # Columns are keypoints 1, 3, 7.
    one, three, seven = [[1.0] * 3] * 3, [[7.0, 0.0, 9.0], [0.12346, 2.0, 3.0], [0.12346, 2.0, 3.0]], [[0.5] * 3] * 3
    assert got["frames"] == [4, 9, 12] and got["edges"] == [[1, 0]] and got["fps"] == 30.0
    assert got["joints"] == [list(x) for x in zip(one, three, seven)]
    assert got["groups"] == [{"name": "r", "color": [1.0, 0.0, 0.0], "positions": [list(x) for x in zip(one, three)]}, {"name": "ungrouped", "color": [0.5, 0.5, 0.5], "positions": [[x] for x in seven]}]
    assert [c["name"] for c in got["cameras"]] == ["cam_0", "cam_2"] and [c["video"] for c in got["cameras"]] == [None, "/v.mp4"]
    c = rig.ring(3)[2]
    r, t = np.array([c[f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([c[f"t{i}"] for i in range(3)])
    m = np.array(got["cameras"][1]["matrix"])
    # A point two units ahead of the lens lies at -2 on the editor's axis; up is up.
    ahead = r.T @ (np.array([0.0, -1.0, 2.0]) - t)
    assert np.allclose(np.linalg.inv(m) @ [*ahead, 1.0], [0.0, 1.0, -2.0, 1.0])
    scenes.write_scene(world, cams, path, 25)
    plain = json.loads((tmp_path / "scene.json").read_text())
    assert plain["joints"] == [] and plain["edges"] == [] and [g["name"] for g in plain["groups"]] == ["ungrouped"]
    with pytest.raises(ValueError):
        scenes.write_scene(world.limit(0), cams, path, 25)
    with pytest.raises(ValueError):
        scenes.write_scene(world, cams.limit(0), path, 25)


def test_dense_trajectories_are_filled_across_blocks(spark):
    """Holes that span blocks, coordinates that are missing alone, and a keypoint that comes late; no task reads a track's rest for each row."""
    rng = np.random.default_rng(3)
    own = {(s, k): [None if rng.random() < 0.3 else float(rng.integers(100)) for _ in "xyz"] for k in range(3) for s in range(-7, 40) if rng.random() < 0.3 and (k < 2 or s > 20) or s in (-7, 39) and k == 0}
    schema = "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double"
    points = spark.createDataFrame([(s, 5, k, *p) for (s, k), p in own.items() if s != -1] + [(0, 4, 0, 1.0, 1.0, 1.0), (-1, 5, 9, 1.0, 1.0, 1.0)], schema)
    want = {}
    for k in range(3):
        for i in range(3):
            known = sorted((s, p[i]) for (s, q), p in own.items() if q == k and p[i] is not None and s != -1)
            for s in range(-7, 40):
                before, after = [v for t, v in known if t <= s], [v for t, v in known if t >= s]
                want.setdefault((s, 5, k), []).append(before[-1] if before else after[0] if after else None)
    for block in (1, 4, 4096):
        found = trajectories.dense_trajectories(points, block)
        assert {tuple(r[:3]): list(r[3:]) for r in found.collect()} == want
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_scene_frames_grow_with_rows_not_with_numbers_of_frames(spark):
    """Numbers of frames far apart: only those seen are filled, over blocks without any frame."""
    far = 10**14
    rows = [(0, 5, 1, 1.0, 1.0, 1.0), (far, 5, 2, 2.0, 2.0, 2.0), (2 * far, 5, 1, 3.0, 3.0, 3.0), (2 * far + 1, 5, 2, None, 4.0, 4.0), (far + 1, 4, 1, 9.0, 9.0, 9.0)]
    found = {r["sync_index"]: [list(p) for p in r["joints"]] for r in scenes.scene_frames(spark.createDataFrame(rows, WORLD)).collect()}
    assert found == {0: [[1.0] * 3, [2.0] * 3], far: [[1.0] * 3, [2.0] * 3], 2 * far: [[3.0] * 3, [2.0] * 3]}
