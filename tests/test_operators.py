"""Hand-computed cases of the operators, and round trips of the files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import schema
from sightline.operators import coverage, filters, places, poses, quantiles, reconstruction, timing, trajectories
from sightline.sources import events, rig, tables
from sightline.streaming import live

OBS = "sync_index long, cam_id long, object_id long, keypoint_id long, img_loc_x double, img_loc_y double, frame_time double"


def test_gap_fill(spark):
    rows = [(1, 0, 0, 1, 10.0, 20.0, None), (3, 0, 0, 1, 30.0, 40.0, None), (1, 1, 0, 2, 100.0, 200.0, None), (3, 1, 0, 2, 300.0, 400.0, None)]
    out = trajectories.fill_image_gaps(spark.createDataFrame(rows, OBS)).filter("sync_index = 2").orderBy("cam_id").collect()
    assert [(r["img_loc_x"], r["img_loc_y"], r["frame_time"]) for r in out] == [(20.0, 30.0, None), (200.0, 300.0, None)]


def test_long_gap_is_filled_in_part(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0, 0.0), (10, 0, 0, 0, 8.0, 8.0, 1.0)], OBS)
    out = trajectories.fill_image_gaps(df, 3).orderBy("sync_index").collect()
    assert [(r["sync_index"], r["img_loc_x"]) for r in out] == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 6.0), (10, 8.0)]
    assert trajectories.fill_image_gaps(df, 3, strict=True).count() == 2
    with pytest.raises(ValueError):
        trajectories.fill_image_gaps(df, 0)


def test_validate(spark):
    good = spark.createDataFrame([("1", "2", "3", "4", "1.5", "NaN")], "sync_index string, object_id string, keypoint_id string, x_coord string, y_coord string, z_coord string")
    with pytest.raises(schema.SchemaError):
        schema.validate(good, schema.WORLD_POINTS)
    with pytest.raises(schema.SchemaError):
        schema.coerce(good.drop("x_coord"), schema.WORLD_POINTS)
    fraction = spark.createDataFrame([(1.5, 1, 1, 0.0, 0.0, 0.0)], "sync_index double, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double")
    with pytest.raises(schema.SchemaError):
        schema.validate(fraction, schema.WORLD_POINTS)
    assert schema.validate(schema.empty(spark, schema.IMAGE_POINTS), schema.IMAGE_POINTS).count() == 0


def test_alignment_with_a_dropped_frame(spark):
    times = [(c, i, i / 30 + c * 1e-4) for c in range(3) for i in range(10) if (c, i) != (1, 4)]
    clocks = timing.dense_frame_index(spark.createDataFrame([(c, t) for c, _, t in times], "cam_id long, frame_time double"))
    out = {(r["sync_index"], r["cam_id"]): r["frame_index"] for r in timing.align(clocks).collect()}
    assert len(out) == 30 and out[4, 1] is None
    assert all(out[s, c] == (s if c != 1 or s < 4 else s - 1) for s in range(10) for c in range(3) if (s, c) != (4, 1))


def test_linkage_and_config(spark):
    df = spark.createDataFrame([(0, c, 0, k, 0.0, 0.0, 0.0) for c in (0, 1, 2) for k in (0, 1) if (c, k) != (1, 1)], OBS)
    out = {(r["cam_id"], r["keypoint_id"]) for r in filters.kill_linkage(df, 0, 1).collect()}
    assert out == {(0, 1), (2, 0), (2, 1)}
    config = filters.FilterConfig().with_linkage(1, 0).with_linkage(0, 1)
    assert config.linkages == ((0, 1),) and config.without_linkage(1, 0).linkages == ()


def test_dropout_share(spark):
    df = spark.range(20000).select((F.col("id") % 500).alias("sync_index"), F.lit(0).cast("long").alias("cam_id"), F.lit(0).cast("long").alias("object_id"), F.expr("id div 500").alias("keypoint_id"))
    assert 0.2 < 1 - filters.random_dropout(df, 0.3).count() / 20000 < 0.4


def test_static_points_triangulate_once(spark):
    cams = rig.cameras(spark, rig.ring(4))
    world = spark.createDataFrame([(-1, 0, 0, 0.1, 0.2, 0.4)], "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double")
    seen = reconstruction.project(world, cams)
    frames = spark.range(5).select(F.col("id").alias("f"))
    rows = seen.crossJoin(frames).select(F.col("f").alias("sync_index"), "cam_id", "object_id", "keypoint_id", "img_loc_x", "img_loc_y", (F.col("f") / 30.0).alias("frame_time"))
    (p,) = reconstruction.triangulate(rows, cams, static_objects=[0]).collect()
    assert (p["sync_index"], p["n_views"], p["frame_time"]) == (-1, 20, None)
    assert np.allclose([p["x_coord"], p["y_coord"], p["z_coord"]], [0.1, 0.2, 0.4], atol=1e-9)


def test_pose_graph():
    z = lambda d: poses._turn(np.array([0, 0, np.radians(d)]))
    first, second = poses.Edge(z(10), np.array([1.0, 0, 0]), 1.0), poses.Edge(z(-10), np.array([0, 1.0, 0]), 1.0)
    graph = poses.PoseGraph({(0, 1): first, (1, 2): second, (7, 8): first})
    assert graph.largest_group() == [0, 1, 2]
    closed = graph.closed()
    assert closed.edges[0, 2].error == 2.0 and np.allclose(closed.edges[0, 2].r, np.eye(3))
    anchor, found = graph.anchored()
    assert anchor == 1 and np.allclose(found[1].r, np.eye(3))


def test_pose_outliers_and_mean(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        r = poses._turn(np.array([0.1, 0.2, 0.3]) + rng.normal(0, 1e-3, 3))
        rows.append((0, 1, i, 0, r.reshape(-1).tolist(), [1.0, 2.0, 3.0]))
    rows.append((0, 1, 99, 0, poses._turn(np.array([2.0, 0, 0])).reshape(-1).tolist(), [9.0, 9.0, 9.0]))
    df = spark.createDataFrame(rows, "cam_a long, cam_b long, sync_index long, object_id long, r array<double>, t array<double>")
    kept = poses.without_outlier_poses(df)
    assert 99 not in {r["sync_index"] for r in kept.collect()}
    (m,) = poses.average_poses(kept).collect()
    assert np.allclose(np.array(m["r"]).reshape(3, 3), poses._turn(np.array([0.1, 0.2, 0.3])), atol=2e-3) and m["t"] == [1.0, 2.0, 3.0]


def test_similarity_needs_points(spark):
    with pytest.raises(ValueError):
        poses.estimate_similarity(spark.createDataFrame([(0.0,) * 6] * 2, "ax double, ay double, az double, bx double, by double, bz double"))
    with pytest.raises(ValueError):
        poses.basis(np.array([0, 0, 1.0]), np.array([0, 0, 2.0]))


def test_smoothing_keeps_a_line(spark):
    rows = [(i, 0, 0, 0.1 * i, 1.0, -0.2 * i, None) for i in range(30)] + [(i, 1, 0, float(i % 2), 0.0, 0.0, None) for i in range(5)]
    df = spark.createDataFrame(rows, schema.WORLD_POINTS)
    out = {(r["object_id"], r["sync_index"]): r for r in trajectories.smooth(df, 6.0, 30.0).collect()}
    assert all(abs(out[0, i]["y_coord"] - 1.0) < 1e-9 and abs(out[0, i]["x_coord"] - 0.1 * i) < 0.02 for i in range(30))
    assert [out[1, i]["x_coord"] for i in range(5)] == [0.0, 1.0, 0.0, 1.0, 0.0]


def test_isolated_camera_warns(spark):
    df = spark.createDataFrame([(0, c, 0, k, 0.0, 0.0, 0.0) for c in (0, 1) for k in range(3)] + [(5, 2, 0, 0, 0.0, 0.0, 0.0)], OBS)
    out = coverage.structural_warnings(df, spark.createDataFrame([(0,), (1,), (2,)], "cam_id long")).collect()
    assert [(r["severity"], r["cam_id"]) for r in out] == [("critical", 2), ("critical", None), ("warning", 0), ("warning", 1)]


def test_files(spark, tmp_path):
    cams = rig.cameras(spark, rig.ring(3, unposed=(2,)))
    tables.write_cameras(cams, str(tmp_path / "rig.toml"))
    back = {r["cam_id"]: r for r in tables.read_cameras(spark, str(tmp_path / "rig.toml")).collect()}
    for r in cams.collect():
        for c in schema.CAMERA_NUMBERS:
            assert (r[c] is None) == (back[r["cam_id"]][c] is None)
            assert r[c] is None or abs(r[c] - back[r["cam_id"]][c]) < 1e-9
    world = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 3.0, None), (1, 0, 0, 1.5, 2.0, 3.0, 0.5)], schema.WORLD_POINTS)
    tables.write_points_csv(world, str(tmp_path / "w"))
    assert sorted(map(tuple, tables.read_points(spark, str(tmp_path / "w"), schema.WORLD_POINTS).collect())) == sorted(map(tuple, world.collect()))
    wide = trajectories.wide(world, {0: "nose"}).withColumn("time", F.col("sync_index") / 30.0)
    tables.write_trc(wide, ["nose"], str(tmp_path / "a.trc"), 30.0)
    lines = (tmp_path / "a.trc").read_text().split("\n")
    assert lines[2].startswith("30\t30\t1\t1\tm") and lines[5] == "" and lines[6] == "0\t0.000\t1.000000\t2.000000\t3.000000"


def test_numbered(spark):
    df = spark.range(1000).selectExpr("cast(pmod(id * 7919, 1000) as long) as v", "id % 3 as w").repartition(7)
    assert all(r["place"] == r["v"] for r in places.numbered(df, "v").collect())
    assert places.numbered(df.limit(0), "v").collect() == []
    twice = sorted(r["place"] for r in places.numbered(df.select("w"), "w").collect())
    assert twice == list(range(1000))


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in range(3) for v in np.concatenate([rng.lognormal(0, 3, 50 * k + 1), [0.0] * k, [2.5] * 7 * k])] + [(0, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    at = (0.0, 0.05, 0.5, 0.95, 1.0)
    for keys in ((), ("k",)):
        for r in quantiles.quantiles(df, "v", at, keys).collect():
            own = [v for k, v in rows if v is not None and (not keys or k == r["k"])]
            assert abs(r["v"] - np.quantile(own, r["percentile"])) <= 1e-12 * max(1.0, r["v"])
    assert quantiles.quantiles(df, "v", at, ("k",)).count() == 15 and quantiles.quantiles(df.limit(0), "v", at).collect() == []


def test_remap_rules(spark):
    kind = "object_id_from long, keypoint_id_from long, object_id_to long, keypoint_id_to long, obj_loc_x double, obj_loc_y double, obj_loc_z double"
    df = spark.createDataFrame([(0, 0, 1, 1, 0.0, 0.0, 0.0)], OBS)
    for rules in ([(1, 1, 2, 2), (1, 1, 3, 3)], [(1, 1, 2, 2), (2, 2, 3, 3)]):
        with pytest.raises(ValueError):
            filters.remap_points(df, spark.createDataFrame([(*r, 0.0, 0.0, 0.0) for r in rules], kind))
    (row,) = filters.remap_points(df, spark.createDataFrame([(1, 1, 2, 5, 0.0, 0.0, 0.0)], kind)).collect()
    assert (row["object_id"], row["keypoint_id"]) == (2, 5)


def test_wide_csv_pairs_and_timestamps(spark, tmp_path):
    world = spark.createDataFrame([(1, 0, 0, 1.5, 2.0, 3.0, 0.5), (0, 0, 0, 1.0, 2.0, 3.0, None), (0, 0, 1, 7.0, 8.0, 9.0, 0.25)], schema.WORLD_POINTS)
    tables.write_wide_labelled(world, {0: "nose", 1: "ear"}, str(tmp_path / "wide"))
    back = spark.read.option("header", True).csv(str(tmp_path / "wide"))
    assert back.columns == ["sync_index", "frame_time", *(f"{n}_{a}" for n in ("ear", "nose") for a in "xyz")]
    assert sorted(map(tuple, back.collect())) == [("0", "0.250000", "7.000000", "8.000000", "9.000000", "1.000000", "2.000000", "3.000000"), ("1", "0.500000", None, None, None, "1.500000", "2.000000", "3.000000")]
    r = tables.rotation_of([0.1, -0.2, 0.3])
    pairs = spark.createDataFrame([(0, 1, r.reshape(-1).tolist(), [1.0, 2.0, 3.0], 0.5), (1, 0, r.T.reshape(-1).tolist(), [0.0] * 3, 0.5)], "cam_a long, cam_b long, r array<double>, t array<double>, error double")
    tables.write_pose_pairs(pairs, str(tmp_path / "p.toml"))
    (found,) = tables.read_pose_pairs(spark, str(tmp_path / "p.toml")).collect()
    assert (found["cam_a"], found["cam_b"], found["t"], found["error"]) == (0, 1, [1.0, 2.0, 3.0], 0.5) and np.allclose(np.array(found["r"]).reshape(3, 3), r)
    folder = str(tmp_path / "recording")
    with pytest.raises(ValueError):
        tables.load_timestamps(spark, folder)
    meta = spark.createDataFrame([(0, 3, 30.0), (1, 3, 30.0)], "cam_id long, frame_count long, fps double")
    inferred = sorted(map(tuple, tables.load_timestamps(spark, folder, meta).collect()))
    assert len(inferred) == 6 and spark.read.option("header", True).csv(folder + "/inferred_timestamps.csv").count() == 6
    tables.write_timestamps(spark.createDataFrame([(0, 0.5), (0, 0.25)], "cam_id long, frame_time double"), folder + "/timestamps.csv")
    assert sorted(map(tuple, tables.load_timestamps(spark, folder, meta).collect())) == [(0, 0, 0.25), (0, 1, 0.5)]


def test_poses_of_solids_and_planes():
    rng = np.random.default_rng(3)
    for n, flat in ((4, True), (9, True), (6, False), (12, False)):
        obj = rng.uniform(-0.3, 0.3, (40, n, 3))
        if flat:
            obj[:, :, 2] = 0.1
        turn = np.array([poses._turn(rng.uniform(-0.8, 0.8, 3)) for _ in range(40)])
        t = rng.uniform(-0.3, 0.3, (40, 3)) + [0, 0, 2]
        c = np.einsum("gij,gnj->gni", turn, obj) + t[:, None]
        und = c[:, :, :2] / c[:, :, 2:]
        r, found, rmse, ok = poses.solve_poses(obj, und)
        assert ok.all() and np.allclose(r, turn, atol=1e-6) and np.allclose(found, t, atol=1e-6) and rmse.max() < 1e-8
    few = poses.solve_poses(rng.uniform(size=(2, 5, 3)), rng.uniform(size=(2, 5, 2)))
    assert not few[3].any() and poses.solve_pose(np.full((4, 3), np.nan), np.zeros((4, 2))) is None


def test_tilt_without_wrong_points(spark):
    """One corner far off doesn't change the tilt; too few points have none."""
    rows, rng = [], np.random.default_rng(1)
    turn, grid = poses._turn(np.array([0.3, -0.4, 0.1])), [(i % 5, i // 5) for i in range(25)]
    for frame, off in ((0, 0.0), (1, 300.0)):
        for k, (x, y) in enumerate(grid):
            c = turn @ np.array([0.1 * x, 0.1 * y, 0.0]) + [0, 0, 2]
            rows.append((frame, 0, 0, k, float(1000 * c[0] / c[2] + off * (k == 7)), float(1000 * c[1] / c[2]), 0.1 * x, 0.1 * y))
    rows += [(2, 0, 0, k, 1.0, 2.0, 0.0, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "sync_index long, cam_id long, object_id long, keypoint_id long, img_loc_x double, img_loc_y double, obj_loc_x double, obj_loc_y double")
    out = {r["sync_index"]: r for r in poses.board_tilts(df, limit=60.0).collect()}
    assert set(out) == {0, 1}
    want = 0.4 * turn[2, :2] / 2
    assert abs(out[1]["magnitude"] - out[0]["magnitude"]) < 1e-9
    assert abs(out[0]["magnitude"] - np.hypot(*want)) < 1e-9 and abs(out[0]["direction"] - np.arctan2(want[1], want[0]) % (2 * np.pi)) < 1e-9


def test_labelled_trajectories_by_hand(spark, data):
    """The flagship against a singular value decomposition of each point."""
    from sightline.plans import queries, registry

    observed = trajectories.fill_image_gaps(queries.obs_of(spark, data))
    cams = {r["cam_id"]: r for r in queries.cams_of(spark).collect()}
    systems: dict = {}
    for r in reconstruction.undistort(observed, queries.cams_of(spark)).collect():
        c = cams[r["cam_id"]]
        p = np.array([[c[f"r{3 * i}"], c[f"r{3 * i + 1}"], c[f"r{3 * i + 2}"], c[f"t{i}"]] for i in range(3)])
        systems.setdefault((r["sync_index"], r["object_id"], r["keypoint_id"]), []).append(np.stack([r["und_x"] * p[2] - p[0], r["und_y"] * p[2] - p[1]]))
    points: dict = {}
    for (sync, _, k), rows in systems.items():
        if len(rows) > 1:
            v = np.linalg.svd(np.concatenate(rows))[2][-1]
            points.setdefault((sync, queries.NAMES[k]), []).append(v[:3] / v[3])
    out = registry.flagship(spark, data).collect()
    assert {r["sync_index"] for r in out} == {s for s, _ in points}
    for r in out:
        for name in set(queries.NAMES.values()):
            want = points.get((r["sync_index"], name))
            for i, a in enumerate("xyz"):
                got = r[f"{name}_{a}"]
                assert (got is None) == (want is None)
                # Rays of made-up pixels can be all but parallel.
                assert want is None or abs(got - np.mean(want, axis=0)[i]) < 1e-4 * max(1.0, np.abs(want).max())


def test_configuration_files(spark, tmp_path):
    import tomllib

    tables.write_aniposelib(rig.cameras(spark, rig.ring(3, ignored=(1,))), str(tmp_path / "a.toml"))
    raw = tomllib.loads((tmp_path / "a.toml").read_text())
    assert set(raw) == {"cam_0", "cam_2", "metadata"} and raw["cam_0"]["name"] == "cam_0"
    rows = [(0, 1, 2, 3, 4, 0.5, 0.001), (1, 1, 0, 1, 1, 0.25, 0.002)]
    df = spark.createDataFrame(rows, tables.DISTANCES)
    tables.write_constraints(df, str(tmp_path / "c.toml"))
    assert sorted(map(tuple, tables.read_constraints(spark, str(tmp_path / "c.toml")).collect())) == rows


def test_rotation_vectors():
    for v in ([0, 0, 0], [0.1, -0.2, 0.3], [np.pi, 0, 0], [0, 3.0, 0.5]):
        assert np.allclose(tables.rotation_of(tables.vector_of(tables.rotation_of(v))), tables.rotation_of(v), atol=1e-9)


def test_stream_equals_batch(spark, data, tmp_path):
    obs = schema.coerce(events.observations(spark, data), schema.IMAGE_POINTS)
    obs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = live.read_observations(spark, str(tmp_path / "in"), 1)
    q = live.tracked_boxes(stream).writeStream.outputMode("update").format("memory").queryName("boxes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {r["cam_id"]: r["n"] for r in spark.sql("select cam_id, max(n) as n from boxes group by cam_id").collect()}
    assert last == {r["cam_id"]: r["count"] for r in obs.groupBy("cam_id").count().collect()}


@pytest.mark.parametrize("most", [5, 100_000])
def test_quantiles_are_those_of_percentile(spark, most):
    """NaN, infinities, negative values, ties and one heavy value; slices of over five values are narrowed."""
    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    sets = {
        0: [float(x) for x in range(1, 100)] + [nan] * 40,
        1: [rng.uniform(-1, 1) * 10 ** rng.randint(-5, 5) for _ in range(400)] + [0.0, -0.0, None],
        2: [7.25] * 500, 3: [7.25] * 500 + [7.25 + i * 1e-12 for i in range(50)] + [inf, -inf], 4: [nan, None], 5: [None], 6: [3.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k long, v double")
    at = (0.0, 0.05, 0.5, 0.9, 0.99, 1.0)
    want = {(r["k"], p): x for r in df.groupBy("k").agg(F.percentile("v", list(at)).alias("q")).filter("q is not null").collect() for p, x in zip(at, r["q"])}
    got = {(r["k"], r["percentile"]): r["v"] for r in quantiles.quantiles(df, "v", at, ("k",), most=most).collect()}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert got[key] == pytest.approx(x, rel=1e-12, nan_ok=True), key
    whole = {r["percentile"]: r["v"] for r in quantiles.quantiles(df.filter("k < 4"), "v", (0.3, 0.7), most=most).collect()}
    assert list(whole.values()) == pytest.approx(df.filter("k < 4").select(F.percentile("v", [0.3, 0.7])).first()[0])
    assert quantiles.quantiles(df.limit(0), "v", at, ("k",)).collect() == []


def sequential_alignment(clocks):
    """The pass over one recording's clocks {cam: [(time, index)]}, as the definition has it."""
    cams = sorted(clocks)
    own = {c: sorted(clocks[c]) for c in cams}
    at, out, sync = dict.fromkeys(cams, 0), [], 0
    while live := [c for c in cams if at[c] < len(own[c])]:
        now = {c: own[c][at[c]][0] for c in live}
        after = {c: own[c][at[c] + 1][0] for c in live if at[c] + 1 < len(own[c])}
        joins = []
        for c in live:
            earliest = min((t for o, t in after.items() if o != c), default=float("inf"))
            latest = max((t for o, t in now.items() if o != c), default=float("-inf"))
            if now[c] <= earliest and earliest - now[c] >= now[c] - latest:
                joins.append(c)
        if joins:
            out += [(sync, c, own[c][at[c]][1] if c in joins else None) for c in cams]
            for c in joins:
                at[c] += 1
            sync += 1
        else:
            at[min(live, key=lambda c: now[c])] += 1
    return out


@pytest.mark.parametrize(("segment", "ahead"), [(7, 4), (40, 3), (10_000, 64)])
def test_alignment_by_segments(spark, segment, ahead):
    """Dropped, late, doubled and jittered frames, a camera that starts late and one that ends early, equal times, two recordings."""
    rng = random.Random(segment)
    rows, want = [], set()
    for name in ("a", None):
        clocks = {}
        for cam in range(4):
            frames = [i for i in range(120) if rng.random() > 0.12 and not (cam == 1 and i < 30) and not (cam == 2 and i > 80)]
            clocks[cam] = [(round(i / 30 + cam * 0.004 + rng.choice([0, 0, rng.uniform(-0.02, 0.02)]), 4), k) for k, i in enumerate(sorted([*frames, *rng.sample(frames, 4)]))]
            rows += [(name, cam, k, t) for t, k in clocks[cam]]
        want |= {(name or "", *r) for r in sequential_alignment(clocks)}
    df = spark.createDataFrame(rows + [("a", 0, 999, None)], "rec string, cam_id long, frame_index long, frame_time double").repartition(5)
    got = [(r["rec"], r["sync_index"], r["cam_id"], r["frame_index"]) for r in timing.align(df, "rec", segment=segment, ahead=ahead).collect()]
    assert len(got) == len(want) and set(got) == want
    one = [tuple(r) for r in timing.align(df.filter("rec = 'a'").drop("rec"), segment=segment, ahead=ahead).collect()]
    assert set(one) == {r[1:] for r in want if r[0] == "a"}
    assert timing.align(df.limit(0), "rec").collect() == []


def plain_smooth(x, cutoff, rate, order):
    """Forward and backward recursion over one column, padded by odd reflection."""
    b, a = trajectories.butterworth(order, cutoff, rate)
    pad = 3 * (order + 1)
    if len(x) <= pad:
        return x
    steady = np.zeros(order)
    for k in range(order - 1, -1, -1):
        steady[k] = (steady[k + 1] if k + 1 < order else 0.0) + b[k + 1] - a[k + 1]

    def run(v):
        s, out = steady * v[0], []
        for value in v:
            y = b[0] * value + s[0]
            s = np.array([(s[k + 1] if k + 1 < order else 0.0) + b[k + 1] * value - a[k + 1] * y for k in range(order)])
            out.append(y)
        return np.array(out)

    whole = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return run(run(whole)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize(("order", "block"), [(2, 10), (2, 100), (3, 64), (2, 4096)])
def test_smoothing_by_blocks(spark, order, block):
    rng = np.random.default_rng(order)
    rows, want = [], {}
    for keypoint, n in enumerate((1, 9, 13, 47, 230, 500)):
        frames = np.sort(rng.choice(2 * n + 3, n, replace=False))
        xyz = rng.normal(0, 1, (n, 3)).cumsum(axis=0)
        rows += [(int(i), 0, keypoint, *map(float, v), None) for i, v in zip(frames, xyz)]
        done = np.column_stack([plain_smooth(xyz[:, k], 5.0, 30.0, order) for k in range(3)])
        want |= {(keypoint, int(i)): tuple(v) for i, v in zip(frames, done)}
    df = spark.createDataFrame(rows, "sync_index long, object_id long, keypoint_id long, x_coord double, y_coord double, z_coord double, frame_time double").repartition(3)
    got = {(r["keypoint_id"], r["sync_index"]): (r["x_coord"], r["y_coord"], r["z_coord"]) for r in trajectories.smooth(df, 5.0, 30.0, order, max(block, 3 * (order + 1) + 1)).collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-9


@pytest.mark.parametrize("block", [1, 3, 50])
def test_gaps_by_blocks(spark, block):
    rng = random.Random(block)
    rows = [(i, cam, 0, k, float(i * k), float(i), i / 30) for cam in range(2) for k in range(3) for i in sorted(rng.sample(range(-10, 60), 25))]
    df = spark.createDataFrame(rows, OBS)
    want = sorted(map(tuple, trajectories.fill_gaps(df, trajectories.IMAGE_TRACK, trajectories.IMAGE_VALUES, 3, block=10**6).collect()))
    assert sorted(map(tuple, trajectories.fill_gaps(df, trajectories.IMAGE_TRACK, trajectories.IMAGE_VALUES, 3, block=block).collect())) == want
    filled = {(r[0], r[1], r[3]) for r in want}
    for cam in range(2):
        for k in range(3):
            own = sorted(r[0] for r in rows if r[1] == cam and r[3] == k)
            assert all((i, cam, k) in filled for a, b in zip(own, own[1:]) for i in range(a + 1, min(b, a + 4)))


def test_fan_out(spark, tmp_path):
    """Two sinks take each file once, agree with a batch run, see the end, and a failed batch comes again to both."""
    rng = random.Random(2)
    source = str(tmp_path / "in")
    rows = [(i, i % 3, 0, k, rng.random(), rng.random(), None, None, None, i / 30) for i in range(40) for k in range(2)]
    kinds = "sync_index long, cam_id long, object_id long, keypoint_id long, img_loc_x double, img_loc_y double, obj_loc_x double, obj_loc_y double, obj_loc_z double, frame_time double"
    every = spark.createDataFrame(rows, kinds)
    for k in range(4):
        every.filter(F.col("sync_index") % 4 == k).coalesce(1).write.mode("append").parquet(source)
    whole = live.FileSink(str(tmp_path / "whole"))
    counts = live.FileSink(str(tmp_path / "counts"), lambda d: d.groupBy("cam_id").agg(F.count("*").alias("n")))
    fails = [True]

    class Weak(live.FileSink):
        def batch(self, rows, batch_id):
            if batch_id == 1 and fails[0]:
                raise RuntimeError("no room")
            super().batch(rows, batch_id)

    weak = Weak(str(tmp_path / "weak"))
    stream = live.read_observations(spark, source, files_per_trigger=1)
    with pytest.raises(Exception, match="no room"):
        live.fan_out(stream, [whole, weak, counts], str(tmp_path / "checkpoint"))
    assert whole.ended(spark) is None
    fails[0] = False
    live.fan_out(live.read_observations(spark, source, files_per_trigger=1), [whole, weak, counts], str(tmp_path / "checkpoint"))
    want = sorted(map(repr, every.collect()))
    assert sorted(map(repr, whole.read(spark).select(*every.columns).collect())) == want == sorted(map(repr, weak.read(spark).select(*every.columns).collect()))
    assert {r["cam_id"]: r["n"] for r in counts.read(spark).groupBy("cam_id").agg(F.sum("n").alias("n")).collect()} == {r["cam_id"]: r["count"] for r in every.groupBy("cam_id").count().collect()}
    assert whole.ended(spark) == counts.ended(spark) == 4
