"""Joint adjustment: derivatives, lenses, distances, bounds and the loss, on scenes whose answer is known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schema
from sightline.operators import constraints, joint, reconstruction
from sightline.sources import rig

WORLD = "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double"


def scene(spark, truth, frames=14):
    """Two markers of side 0.2 that turn and move, and free points."""
    rng = np.random.default_rng(3)
    rows = []
    from sightline.operators.poses import _turn

    for s in range(frames):
        for o in (0, 1):
            turn, at = _turn(rng.normal(0, 0.8, 3)), rng.uniform(-0.6, 0.6, 3) + [0, 0, 0.5]
            rows += [(s, o, i, *map(float, turn @ np.array([0.2 * x, 0.2 * y, 0.0]) + at)) for i, (x, y) in enumerate(constraints.CORNERS)]
        rows += [(s, 7, i, *map(float, rng.uniform(-0.5, 0.5, 3) + [0, 0, 0.5])) for i in range(3)]
    world = spark.createDataFrame(rows, WORLD)
    cams = rig.cameras(spark, truth)
    obs = reconstruction.project(world, cams).drop("width", "height", "depth").withColumn("frame_time", F.lit(None).cast("double"))
    sides = constraints.marker_constraints(spark.createDataFrame([(0, 0.2), (1, 0.2)], "object_id long, side double"))
    return world, obs, sides


def off(truth, factor=1.03, k1=0.02):
    """The rig with wrong lenses (not of fisheyes) and slightly wrong poses."""
    return [{**c, **({} if c["fisheye"] else {"fx": c["fx"] * factor, "fy": c["fy"] * factor, "k1": c["k1"] + k1}), "t0": c["t0"] + 0.004 * (i > 0), "t2": c["t2"] - 0.006 * (i > 1)} for i, c in enumerate(truth)]


@pytest.mark.parametrize("fisheye", [False, True])
def test_derivatives(fisheye):
    c = rig.ring(3, fisheye=(0, 1, 2) if fisheye else ())
    col = lambda *n: np.array([[x[k] for k in n] for x in c])
    k = joint.Cameras(np.arange(3), col(*(f"r{i}" for i in range(9))).reshape(-1, 3, 3), col("t0", "t1", "t2"), col("fx", "fy", "cx", "cy", "p1", "p2", "k3"), np.column_stack([np.ones(3), col("k1", "k2")]), np.full(3, fisheye), np.full(3, not fisheye))
    x, cam, h = np.random.default_rng(0).uniform(-0.4, 0.4, (30, 3)), np.arange(30) % 3, 1e-6
    _, jc, jp = joint._pixels(k, cam, x)
    for i in range(joint.SIZE if not fisheye else 6):
        step = np.zeros((3, joint.SIZE))
        step[:, i] = h
        slope = (joint._pixels(k.moved(step), cam, x)[0] - joint._pixels(k.moved(-step), cam, x)[0]) / (2 * h)
        assert np.allclose(slope, jc[:, :, i], rtol=1e-5, atol=1e-3)
    for i in range(3):
        slope = (joint._pixels(k, cam, x + h * np.eye(3)[i])[0] - joint._pixels(k, cam, x - h * np.eye(3)[i])[0]) / (2 * h)
        assert np.allclose(slope, jp[:, :, i], rtol=1e-5, atol=1e-3)


def test_lenses_poses_and_scale_are_recovered(spark):
    truth = rig.ring(4, fisheye=(3,))
    world, obs, sides = scene(spark, truth)
    start = rig.cameras(spark, off(truth))
    out = joint.adjust(obs, reconstruction.triangulate(obs, start), start, sides, lenses=True)
    assert out.rmse_before > 1 and out.rmse < 1e-3 and out.distance_rmse < 1e-6 and out.converged and out.near_bounds == ()
    for got, want in zip(out.cameras.orderBy("cam_id").collect(), truth):
        assert abs(got["fx"] / want["fx"] - 1) < 1e-5 and abs(got["fy"] / want["fy"] - 1) < 1e-5
        assert abs(got["k1"] - want["k1"]) < 1e-4 and abs(got["k2"] - want["k2"]) < 2e-3 and got["p1"] == want["p1"]
    pairs = out.world.join(world.select(*schema.WORLD_KEY, *(F.col(f"{c}_coord").alias(c) for c in "xyz")), list(schema.WORLD_KEY))
    assert pairs.count() == world.count()
    assert pairs.select(F.max(F.abs(F.col("x_coord") - F.col("x")) + F.abs(F.col("y_coord") - F.col("y")))).first()[0] < 1e-3
    assert out.cameras.columns == start.columns


def test_groups_are_eliminated_as_a_dense_solver_would(spark):
    """One step's system equals that of all parameters at once, with points and distances."""
    truth = rig.ring(3)
    _, obs, sides = scene(spark, truth, frames=2)
    start = rig.cameras(spark, off(truth))
    points = reconstruction.triangulate(obs, start)
    k = joint.Cameras.collect(start, True)
    found = points.select(*schema.WORLD_KEY, *joint.XYZ).toPandas()
    place = {tuple(r): i for i, r in enumerate(found[list(schema.WORLD_KEY)].to_numpy())}
    seen = obs.select(*schema.WORLD_KEY, "cam_id", "img_loc_x", "img_loc_y").toPandas()
    p, cam = np.array([place[tuple(r)] for r in seen[list(schema.WORLD_KEY)].to_numpy()]), seen["cam_id"].to_numpy()
    x, c9 = found[list(joint.XYZ)].to_numpy(), joint.SIZE * 3
    pixel, jc, jp = joint._pixels(k, cam, x[p])
    res = (pixel - seen[["img_loc_x", "img_loc_y"]].to_numpy()).reshape(-1)
    jac = np.zeros((len(seen), 2, c9 + x.size))
    for i in range(len(seen)):
        jac[i][:, joint.SIZE * cam[i] :][:, : joint.SIZE] = jc[i]
        jac[i][:, c9 + 3 * p[i] :][:, :3] = jp[i]
    jac, extra = jac.reshape(-1, c9 + x.size), []
    for s in range(2):
        for r in sides.collect():
            a, b = place[s, r["object_id_a"], r["keypoint_id_a"]], place[s, r["object_id_b"], r["keypoint_id_b"]]
            d, w = x[a] - x[b], 1 / r["sigma"]
            row = np.zeros(c9 + x.size)
            row[c9 + 3 * a : c9 + 3 * a + 3], row[c9 + 3 * b : c9 + 3 * b + 3] = w * d / np.linalg.norm(d), -w * d / np.linalg.norm(d)
            extra.append((row, w * (np.linalg.norm(d) - r["distance"])))
    jac, res = np.vstack([jac, [e[0] for e in extra]]), np.concatenate([res, [e[1] for e in extra]])
    h, g, low = jac.T @ jac, jac.T @ res, slice(c9, None)
    back = h[:c9, low] @ np.linalg.inv(h[low, low])
    got = joint.adjust(obs, points, start, sides, lenses=True, rounds=0)
    assert np.isclose(got.cost, (res**2).sum() / 2)
    systems = []
    original = joint._system
    try:
        joint._system = lambda rows, *a: systems.append(original(rows, a[0], a[1], 0.0, None)) or systems[-1]
        joint.adjust(obs, points, start, sides, lenses=True, rounds=0)
    finally:
        joint._system = original
    s, right, _ = systems[0]
    assert np.allclose(s, h[:c9, :c9] - back @ h[low, :c9], rtol=1e-6, atol=1e-6 * np.abs(s).max())
    assert np.allclose(right, g[:c9] - back @ g[low], rtol=1e-6, atol=1e-6 * np.abs(g).max())


def test_bounds_hold_and_are_reported(spark):
    truth = rig.ring(3)
    _, obs, sides = scene(spark, truth, frames=6)
    start = rig.cameras(spark, [{**c, "fx": c["fx"] * 2.2, "fy": c["fy"] * 2.2} for c in truth])
    out = joint.adjust(obs, reconstruction.triangulate(obs, start), start, sides, lenses=True, rounds=12)
    for got, first in zip(out.cameras.orderBy("cam_id").collect(), start.orderBy("cam_id").collect()):
        assert got["fx"] / first["fx"] >= 0.5 - 1e-12 and abs(got["k1"]) <= 1 and abs(got["k2"]) <= 2
    assert {(b.parameter, b.bound) for b in out.near_bounds} >= {("factor", 0.5)}


def test_a_robust_loss_holds_against_outliers(spark):
    truth = rig.ring(4)
    _, obs, sides = scene(spark, truth)
    bad = obs.withColumn("img_loc_x", F.col("img_loc_x") + F.when((F.col("cam_id") == 1) & (F.col("sync_index") % 5 == 0) & (F.col("object_id") == 7), 60.0).otherwise(0.0))
    start = rig.cameras(spark, off(truth, 1.0, 0.0))
    points = reconstruction.triangulate(bad, start)
    apart = []
    for robust in (None, 1.0):
        out = joint.adjust(bad, points, start, sides, robust=robust, rounds=20)
        apart.append(max(abs(g[f"t{i}"] - w[f"t{i}"]) for g, w in zip(out.cameras.orderBy("cam_id").collect(), truth) for i in range(3)))
    assert apart[1] < 0.2 * apart[0]


def test_odd_tables(spark):
    truth = rig.ring(3)
    world, obs, sides = scene(spark, truth, frames=1)
    cams = rig.cameras(spark, truth)
    out = joint.adjust(obs.limit(0), world, cams, sides, lenses=True)
    assert out.world.count() == 0 and out.distance_rmse is None and out.converged and out.cameras.count() == 3
    odd = sides.unionByName(sides.withColumn("sigma", F.lit(0.0))).unionByName(sides.withColumn("distance", F.lit(None).cast("double"))).withColumn("note", F.lit("x"))
    twice = obs.unionByName(obs).unionByName(obs.withColumn("img_loc_x", F.lit(None).cast("double")))
    out = joint.adjust(twice.withColumn("unit", F.lit(5)), world.withColumn("members", F.lit(1)), cams, odd, rounds=2)
    assert out.world.count() == world.count() and out.rmse < 1e-6


def test_batches_are_cut_to_a_few_groups():
    import pyarrow as pa

    whole = pa.record_batch([pa.array(range(1200))], names=["x"])
    parts = list(joint._slices(iter([whole, whole.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= joint.GROUPS < 1200 and sum((p.column("x").to_pylist() for p in parts), []) == [*range(1200)]
