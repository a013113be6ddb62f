"""Lenses from boards: closed form from homographies, then least squares whose equations Spark sums over views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.poses import _by_size, _projective, _turns, _views, solve_poses
from sightline.operators.reconstruction import undistort
from sightline.sources.checkpoints import use_checkpoints

LENS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2", "k3")
VIEW = ("cam_id", "sync_index")
#: Views whose equations a task holds at once.
VIEWS = 512
#: Damping at first, and its factor after a step that helped and one that didn't.
DAMPING, EASE, BRAKE = 1e-3, 0.1, 10.0


def default_lenses(cameras: DataFrame) -> DataFrame:
    """``cameras`` with a guess for each lens: half the width as focal length, the middle, no distortion.
    There is none for fisheye lenses, and none without a size."""
    if cameras.filter("coalesce(fisheye, false) or width is null or height is null").limit(1).count():
        raise ValueError("a guess needs the image size, and is no good for fisheye lenses")
    half = F.col("width") / 2.0
    guess = {"fx": half, "fy": half, "cx": half, "cy": F.col("height") / 2.0} | {k: F.lit(0.0) for k in LENS[4:]}
    return cameras.withColumns(guess)


def without_lenses(cameras: DataFrame) -> DataFrame:
    return cameras.withColumns({c: F.lit(None).cast("double") for c in LENS})


def without_poses(cameras: DataFrame) -> DataFrame:
    return cameras.withColumns({c: F.lit(None).cast("double") for c in (*(f"r{i}" for i in range(9)), "t0", "t1", "t2")})


def calibration_views(points: DataFrame, frames: DataFrame | None = None, least: int = 4) -> DataFrame:
    """(cam_id, sync_index, n, v): of each view with ``least`` corners, its corners' places on the board and in the image
    one after another. ``frames`` (cam_id, sync_index) selects views. A missing depth on the board is 0."""
    seen = points.filter("obj_loc_x is not null and obj_loc_y is not null and img_loc_x is not null and img_loc_y is not null")
    seen = seen.withColumn("obj_loc_z", F.coalesce(F.nanvl("obj_loc_z", F.lit(0.0)), F.lit(0.0)))
    if frames is not None:
        seen = seen.join(frames.select(*VIEW).distinct(), list(VIEW), "left_semi")
    return _views(seen, ("obj_loc_x", "obj_loc_y", "obj_loc_z", "img_loc_x", "img_loc_y"), VIEW, least)


def project(lens: np.ndarray, fisheye: bool, c: np.ndarray) -> np.ndarray:
    """Pixels of points before the camera (..., 3)."""
    fx, fy, cx, cy, k1, k2, p1, p2, k3 = lens
    a, b = c[..., 0] / c[..., 2], c[..., 1] / c[..., 2]
    q = a * a + b * b
    if fisheye:
        r = np.sqrt(q)
        t = np.arctan(r)
        s = np.where(r > 1e-12, t * (1 + t**2 * (k1 + t**2 * (k2 + t**2 * (p1 + t**2 * p2)))) / np.maximum(r, 1e-12), 1.0)
        dx = dy = 0.0
    else:
        s = 1 + q * (k1 + q * (k2 + q * k3))
        dx, dy = 2 * p1 * a * b + p2 * (q + 2 * a * a), p1 * (q + 2 * b * b) + 2 * p2 * a * b
    return np.stack([fx * (a * s + dx) + cx, fy * (b * s + dy) + cy], axis=-1)


def _at(obj: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return np.einsum("gij,gnj->gni", r, obj) + t[:, None]


def _equations(lens: np.ndarray, fisheye: bool, obj: np.ndarray, img: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(derivatives of the pixels by 9 lens and 6 pose numbers, residuals) of each view, by central differences."""
    c = _at(obj, r, t)
    flat = lambda x: x.reshape(len(obj), -1)
    columns = []
    for k in range(9):
        h = 1e-6 * max(1.0, abs(lens[k]))
        step = np.eye(9)[k] * h
        columns.append(flat(project(lens + step, fisheye, c) - project(lens - step, fisheye, c)) / (2 * h))
    turned = c - t[:, None]
    for k in range(6):
        h, unit = 1e-6, np.zeros(3)
        unit[k % 3] = h
        d = np.cross(unit, turned) if k < 3 else np.broadcast_to(unit, c.shape)
        columns.append(flat(project(lens, fisheye, c + d) - project(lens, fisheye, c - d)) / (2 * h))
    return np.stack(columns, axis=2), flat(project(lens, fisheye, c) - img)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of symmetric matrices; pseudo-inverses, which take much longer, of those only that are nearly singular."""
    try:
        with np.errstate(all="ignore"):
            out = np.linalg.inv(a)
            bad = ~(np.abs(a @ out - np.eye(a.shape[-1])).max(axis=(1, 2)) < 1e-6)
    except np.linalg.LinAlgError:
        out, bad = np.empty_like(a), np.ones(len(a), bool)
    if bad.any():
        out[bad] = np.linalg.pinv(a[bad], hermitian=True)
    return out


def _reduced(jac: np.ndarray, res: np.ndarray, damping: float) -> tuple[np.ndarray, ...]:
    """The views' equations, and what is left of the lens's when the pose is solved for: (C^-1, B, b, S, s)."""
    full = np.einsum("gni,gnj->gij", jac, jac)
    right = np.einsum("gni,gn->gi", jac, res)
    pose = full[:, 9:, 9:]
    pose = pose + damping * np.einsum("gii->gi", pose)[:, :, None] * np.eye(6)
    inverse = _inverse(pose)
    cross = full[:, :9, 9:]
    left = full[:, :9, :9] - cross @ inverse @ cross.transpose(0, 2, 1)
    return inverse, cross, right, left, right[:, :9] - np.einsum("gij,gj->gi", cross @ inverse, right[:, 9:])


def closed_form(sums: np.ndarray, width: float, height: float) -> np.ndarray | None:
    """(fx, fy, cx, cy) without skew from the summed constraints of homographies; None if they don't fix them."""
    values, vectors = np.linalg.eigh(sums)
    if not np.isfinite(values).all() or values[1] <= 1e-12 * values[-1]:
        return None
    b11, b22, b13, b23, b33 = vectors[:, 0]
    if b11 * b22 <= 0:
        return None
    cx, cy = -b13 / b11, -b23 / b22
    scale = b33 - b13 * b13 / b11 - b23 * b23 / b22
    if scale / b11 <= 0 or scale / b22 <= 0:
        return None
    # Pixels were taken from the middle, in units of the larger side.
    size = max(width, height)
    found = np.array([np.sqrt(scale / b11), np.sqrt(scale / b22), cx, cy]) * size + [0, 0, (width - 1) / 2, (height - 1) / 2]
    inside = 0 < found[2] < width and 0 < found[3] < height and (found[:2] < 20 * size).all()
    return found if inside else None


def _first_lenses(views: DataFrame, cameras: list) -> dict[int, np.ndarray]:
    """Of each camera: from homographies, or the larger side (fisheye: by pi) and the middle where they don't tell."""
    sizes = {c["cam_id"]: (float(c["width"]), float(c["height"]), bool(c["fisheye"])) for c in cameras}

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cams = batch.column("cam_id").to_numpy()
            for at, x in _by_size(batch, 5):
                known = np.array([c in sizes and not sizes[c][2] for c in cams[at]])
                at, x = at[known], x[known]
                if not len(at):
                    continue
                w, h = np.array([sizes[c][:2] for c in cams[at]]).T
                mid = np.stack([(w - 1) / 2, (h - 1) / 2], axis=1)
                image = (x[:, :, 3:] - mid[:, None]) / np.maximum(w, h)[:, None, None]
                lo = x[:, :, :2].mean(axis=1, keepdims=True)
                span = np.maximum(np.abs(x[:, :, :2] - lo).max(axis=(1, 2)), 1e-12)
                p = np.concatenate([(x[:, :, :2] - lo) / span[:, None, None], np.ones((*x.shape[:2], 1))], axis=2)
                m = _projective(p, image)
                m = m / np.linalg.norm(m[:, :, :2], axis=(1, 2))[:, None, None]

                def row(i: int, j: int) -> np.ndarray:
                    a, b = m[:, :, i], m[:, :, j]
                    return np.stack([a[:, 0] * b[:, 0], a[:, 1] * b[:, 1], a[:, 0] * b[:, 2] + a[:, 2] * b[:, 0], a[:, 1] * b[:, 2] + a[:, 2] * b[:, 1], a[:, 2] * b[:, 2]], axis=1)

                v = np.stack([row(0, 1), row(0, 0) - row(1, 1)], axis=1)
                sums = np.einsum("gki,gkj->gij", v, v).reshape(len(at), 25)
                sums[~np.isfinite(sums).all(axis=1)] = 0.0
                yield pa.record_batch([pa.array(cams[at]), pa.array(list(sums))], names=["cam_id", "s"])

    flat = views.filter(F.forall(F.sequence(F.lit(2), F.size("v") - 3, F.lit(5)), lambda i: F.get("v", i) == F.get("v", F.lit(2))))
    rows = flat.mapInArrow(work, "cam_id long, s array<double>")
    sums = {r["cam_id"]: np.array(r["s"]).reshape(5, 5) for r in _summed(rows, "s", 25).collect()}
    out = {}
    for cam, (w, h, fisheye) in sizes.items():
        found = closed_form(sums[cam], w, h) if cam in sums else None
        guess = np.array([max(w, h) / (np.pi if fisheye else 1.0)] * 2 + [(w - 1) / 2, (h - 1) / 2])
        out[cam] = np.concatenate((guess if found is None else found, np.zeros(5)))
    return out


def _summed(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Arrays of ``n`` numbers, summed by camera before and after the shuffle."""
    return rows.groupBy("cam_id").agg(F.array(*(F.sum(F.get(column, F.lit(i))) for i in range(n))).alias(column), F.count("*").alias("views"))


def calibrate(points: DataFrame, cameras: DataFrame, frames: DataFrame | None = None, rounds: int = 40) -> DataFrame:
    """(cam_id, fx ... k3, rmse, n_frames) of cameras with a size and views with a pose: pixels of boards, in the selected
    views. Fisheye lenses have four terms in k1, k2, p1, p2.

    A view is small and stays a row: in each round tasks solve its pose out of its equations, Spark sums what is left
    for the lens, 9 numbers a camera, and the driver takes one damped step for each camera. Cameras with fewer than
    two views with a pose have no result.
    """
    use_checkpoints(points.sparkSession)
    rig = cameras.filter("width is not null and height is not null").select("cam_id", "width", "height", F.coalesce("fisheye", F.lit(False)).alias("fisheye")).collect()
    round_lens = {c["cam_id"]: c["fisheye"] for c in rig}
    views = calibration_views(points, frames).filter(F.col("cam_id").isin([*round_lens])).checkpoint()
    lens = _first_lenses(views, rig)
    state = _posed(views, points.sparkSession, cameras, lens).checkpoint()
    damping = dict.fromkeys(lens, DAMPING)
    count = {r["cam_id"]: (r["views"], r["n"]) for r in state.groupBy("cam_id").agg(F.count("*").alias("views"), F.sum("n").alias("n")).collect()}
    live = {cam for cam in lens if count.get(cam, (0, 0))[0] >= 2}
    cost: dict[int, float] = {}
    step: dict[int, np.ndarray] = {}
    accepted: set[int] = set()
    for _ in range(rounds):
        if not live:
            break
        found = {r["cam_id"]: np.array(r["e"]) for r in _summed(_reduce(state, lens, round_lens, damping, live, accepted), "e", 91).collect()}
        for cam in live:
            e = found[cam]
            cost[cam] = e[90]
            left, right = e[:81].reshape(9, 9), e[81:90]
            free = [k for k in range(9) if not (round_lens[cam] and k == 8)]
            own = left[np.ix_(free, free)] + damping[cam] * np.diag(np.diag(left)[free])
            step[cam] = np.zeros(9)
            step[cam][free] = -np.linalg.lstsq(own, right[free], rcond=None)[0]
        state = _stepped(state, lens, step, round_lens, damping, live, accepted).checkpoint()
        tried = {r["cam_id"]: r["cost"] for r in state.groupBy("cam_id").agg(F.sum("tried").alias("cost")).collect()}
        accepted, done = set(), set()
        for cam in live:
            better = np.isfinite(tried[cam]) and tried[cam] <= cost[cam]
            small = cost[cam] - tried[cam] <= 1e-12 * cost[cam] + 1e-14 * count[cam][1] if better else damping[cam] > 1e8
            if better:
                lens[cam] = lens[cam] + step[cam]
                cost[cam], damping[cam] = tried[cam], damping[cam] * EASE
                accepted.add(cam)
            else:
                damping[cam] *= BRAKE
            if small:
                done.add(cam)
        live -= done
    rows = [(int(cam), *map(float, lens[cam]), float(np.sqrt(cost[cam] / count[cam][1])), int(count[cam][0])) for cam in cost]
    return points.sparkSession.createDataFrame(rows, "cam_id long, " + ", ".join(f"{c} double" for c in LENS) + ", rmse double, n_frames long")


STATE = "cam_id long, sync_index long, n int, v array<double>, r array<double>, t array<double>, r2 array<double>, t2 array<double>, tried double"


def _posed(views: DataFrame, spark, cameras: DataFrame, lens: dict[int, np.ndarray]) -> DataFrame:
    """The views with a first pose, as the first lenses see them; views without one are left out."""
    guess = spark.createDataFrame([(c, *map(float, x)) for c, x in lens.items()], "cam_id long, " + ", ".join(f"{c} double" for c in LENS))
    guess = cameras.select("cam_id", "fisheye").join(guess, "cam_id")
    corner = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(*(F.get("v", i * 5 + k).alias(c) for k, c in enumerate(("ox", "oy", "oz", "img_loc_x", "img_loc_y"))))))
    flat = undistort(views.select(*VIEW, corner.alias("keypoint_id", "c")).select(*VIEW, "keypoint_id", "c.*"), guess)
    own = _views(flat, ("ox", "oy", "oz", "img_loc_x", "img_loc_y", "und_x", "und_y"), VIEW, 4)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at, x in _by_size(batch, 7):
                r, t, _, ok = solve_poses(x[:, :, :3], x[:, :, 5:])
                ok &= np.isfinite(r).all(axis=(1, 2)) & np.isfinite(t).all(axis=1)
                r, t = list(r[ok].reshape(-1, 9)), list(t[ok])
                keys = [batch.column(c).take(pa.array(at[ok])) for c in (*VIEW, "n")]
                yield pa.record_batch([*keys, *(pa.array(list(y), pa.list_(pa.float64())) for y in (x[ok][:, :, :5].reshape(len(r), -1), r, t, r, t)), pa.array(np.zeros(len(r)))], names=["cam_id", "sync_index", "n", "v", "r", "t", "r2", "t2", "tried"])

    return own.mapInArrow(work, STATE)


def _pose_arrays(batch) -> dict[str, np.ndarray]:
    return {c: np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, k) for c, k in (("r", 9), ("t", 3), ("r2", 9), ("t2", 3))}


def _slices(batches: Iterator) -> Iterator:
    """Batches of VIEWS views at most, whose equations stay in the processor's cache."""
    for batch in batches:
        for lo in range(0, batch.num_rows, VIEWS):
            yield batch.slice(lo, VIEWS)


def _batches(batch, live: set[int], accepted: set[int]):
    """(camera, places, board, image, rotations, translations) of a batch's views by camera and number of corners; the
    poses of the last step where it was accepted."""
    cams = batch.column("cam_id").to_numpy()
    arrays = _pose_arrays(batch)
    for at, x in _by_size(batch, 5):
        for cam in np.unique(cams[at]).tolist():
            if cam in live:
                own = cams[at] == cam
                new = "2" if cam in accepted else ""
                r, t = arrays["r" + new][at[own]].reshape(-1, 3, 3), arrays["t" + new][at[own]]
                yield cam, at[own], x[own][:, :, :3], x[own][:, :, 3:], r, t


def _reduce(state: DataFrame, lens: dict, fisheye: dict, damping: dict, live: set[int], accepted: set[int]) -> DataFrame:
    """(cam_id, e): the views' shares of the lens's equations (9x9, 9) and of the cost."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(batches):
            for cam, at, obj, img, r, t in _batches(batch, live, accepted):
                jac, res = _equations(lens[cam], fisheye[cam], obj, img, r, t)
                _, _, _, left, right = _reduced(jac, res, damping[cam])
                e = np.concatenate([left.reshape(len(at), 81), right, (res**2).sum(axis=1)[:, None]], axis=1).sum(axis=0)
                yield pa.record_batch([pa.array([cam]), pa.array([e], pa.list_(pa.float64()))], names=["cam_id", "e"])

    return state.mapInArrow(work, "cam_id long, e array<double>")


def _stepped(state: DataFrame, lens: dict, step: dict, fisheye: dict, damping: dict, live: set[int], accepted: set[int]) -> DataFrame:
    """The views with the poses that go with each camera's step beside those before it, and their cost there."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _slices(batches):
            arrays = _pose_arrays(batch)
            tried = batch.column("tried").to_numpy().copy()
            for cam, at, obj, img, r, t in _batches(batch, live, accepted):
                jac, res = _equations(lens[cam], fisheye[cam], obj, img, r, t)
                inverse, cross, right, _, _ = _reduced(jac, res, damping[cam])
                pose = -np.einsum("gij,gj->gi", inverse, right[:, 9:] + np.einsum("gij,i->gj", cross, step[cam]))
                r2, t2 = _turns(pose[:, :3]) @ r, t + pose[:, 3:]
                c = _at(obj, r2, t2)
                with np.errstate(all="ignore"):
                    off = ((project(lens[cam] + step[cam], fisheye[cam], c) - img) ** 2).sum(axis=(1, 2))
                tried[at] = np.where((c[:, :, 2] > 0).all(axis=1), off, np.inf)
                for name, y in (("r", r.reshape(-1, 9)), ("t", t), ("r2", r2.reshape(-1, 9)), ("t2", t2)):
                    arrays[name][at] = y
            own = [batch.column(c) for c in ("cam_id", "sync_index", "n", "v")]
            yield pa.record_batch([*own, *(pa.FixedSizeListArray.from_arrays(pa.array(arrays[c].reshape(-1)), arrays[c].shape[1]).cast(pa.list_(pa.float64())) for c in ("r", "t", "r2", "t2")), pa.array(tried)], names=batch.schema.names)

    return state.mapInArrow(work, STATE)
