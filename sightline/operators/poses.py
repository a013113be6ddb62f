"""Camera poses from observed objects: per-frame pose, relative poses, their consensus, and the pose graph."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import geometry as G
from sightline.operators.filters import posed

POSE = "cam_id long, sync_index long, object_id long, r array<double>, t array<double>, rmse double, n long"


def _turn(w: np.ndarray) -> np.ndarray:
    """Rotation of a rotation vector."""
    angle = np.linalg.norm(w)
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = w / angle
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def _turns(w: np.ndarray) -> np.ndarray:
    """Rotations of rotation vectors (rows)."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    x, y, z = (w / np.maximum(angle[:, :, 0], 1e-300)).T
    zero = np.zeros_like(x)
    k = np.stack([zero, -z, y, z, zero, -x, -y, x, zero], axis=1).reshape(-1, 3, 3)
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)


def _nearest_rotations(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    u[:, :, 2] *= np.linalg.det(u @ vt)[:, None]
    return u @ vt


def _projective(p: np.ndarray, image: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """The 3-row matrices that take each group's homogeneous points ``p`` to its image points, up to scale."""
    x, y = image[:, :, :1], image[:, :, 1:]
    zero = np.zeros_like(p)
    a = np.concatenate([np.concatenate([p, zero, -x * p], axis=2), np.concatenate([zero, p, -y * p], axis=2)], axis=1)
    if weight is not None:
        a = a * np.concatenate([weight, weight], axis=1)[:, :, None]
    return np.linalg.svd(a)[2][:, -1].reshape(len(p), 3, -1)


def _starts(obj: np.ndarray, und: np.ndarray, flat: bool) -> tuple[np.ndarray, np.ndarray]:
    """First poses: from the homography of a plane, or by direct linear transformation."""
    p = np.concatenate([obj[:, :, :2] if flat else obj, np.ones((*obj.shape[:2], 1))], axis=2)
    h = _projective(p, und)
    h = h * np.where(np.einsum("gj,gnj->gn", h[:, 2], p).mean(axis=1) < 0, -1.0, 1.0)[:, None, None]
    if flat:
        h = h / ((np.linalg.norm(h[:, :, 0], axis=1) + np.linalg.norm(h[:, :, 1], axis=1)) / 2)[:, None, None]
        r = _nearest_rotations(np.stack([h[:, :, 0], h[:, :, 1], np.cross(h[:, :, 0], h[:, :, 1])], axis=2))
        return r, h[:, :, 2] - r[:, :, 2] * obj[:, :1, 2]
    scale = np.cbrt(np.abs(np.linalg.det(h[:, :, :3])))[:, None, None]
    scale[scale == 0] = 1.0
    return _nearest_rotations(h[:, :, :3] / scale), h[:, :, 3] / scale[:, :, 0]


def solve_poses(obj: np.ndarray, und: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotations, translations, rmse (normalised units) and validity of many objects before
    cameras, each of the same number of points: ``obj`` (groups, points, 3), ``und`` (groups, points, 2).

    Planes need four points, other objects six; then Gauss-Newton steps on the reprojection,
    of all groups at once.
    """
    g, n = obj.shape[:2]
    flat = np.ptp(obj[:, :, 2], axis=1) < 1e-6
    ok = np.isfinite(obj).all(axis=(1, 2)) & np.isfinite(und).all(axis=(1, 2)) & np.where(flat, n >= 4, n >= 6)
    r, t, rmse = np.tile(np.eye(3), (g, 1, 1)), np.zeros((g, 3)), np.full(g, np.nan)
    for plane in (True, False):
        which = np.flatnonzero(ok & (flat == plane))
        if len(which):
            r[which], t[which] = _starts(obj[which], und[which], plane)
    live = np.flatnonzero(ok)
    for _ in range(rounds):
        turned = np.einsum("gij,gnj->gni", r[live], obj[live])
        c = turned + t[live][:, None]
        bad = (np.abs(c[:, :, 2]) < 1e-9).any(axis=1)
        ok[live[bad]] = False
        live, turned, c = live[~bad], turned[~bad], c[~bad]
        if not len(live):
            break
        iz = 1 / c[:, :, 2]
        a, b, zero = c[:, :, 0] * iz, c[:, :, 1] * iz, np.zeros_like(iz)
        res = np.concatenate([a - und[live, :, 0], b - und[live, :, 1]], axis=1)
        d = np.concatenate([np.stack([iz, zero, -a * iz], axis=2), np.stack([zero, iz, -b * iz], axis=2)], axis=1)
        jac = np.concatenate([np.cross(np.concatenate([turned, turned], axis=1), d), d], axis=2)
        step = -np.einsum("gij,gj->gi", np.linalg.pinv(np.einsum("gni,gnj->gij", jac, jac), hermitian=True), np.einsum("gni,gn->gi", jac, res))
        r[live], t[live] = _turns(step[:, :3]) @ r[live], t[live] + step[:, 3:]
        live = live[np.abs(step).max(axis=1) >= 1e-12]
    at = np.flatnonzero(ok)
    c = np.einsum("gij,gnj->gni", r[at], obj[at]) + t[at][:, None]
    ok[at[(c[:, :, 2] <= 0).any(axis=1)]] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        rmse[at] = np.sqrt((((c[:, :, :2] / c[:, :, 2:]) - und[at]) ** 2).sum(axis=2).mean(axis=1))
    if len(at):
        r[at] = _nearest_rotations(r[at])
    return r, t, rmse, ok


def solve_pose(obj: np.ndarray, und: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Rotation, translation and rmse of one object; None if it has no pose."""
    r, t, rmse, ok = solve_poses(np.asarray(obj, float)[None], np.asarray(und, float)[None], rounds)
    return (r[0], t[0], float(rmse[0])) if ok[0] else None


def _views(points: DataFrame, fields: tuple[str, ...], keys: tuple[str, ...], least: int) -> DataFrame:
    """(keys, n, v): the fields of each group's points one after another, in the order of the points."""
    own = F.struct("keypoint_id", *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(fields)))
    groups = points.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("p")).withColumn("n", F.size("p")).filter(F.col("n") >= least)
    return groups.select(*keys, "n", F.flatten(F.transform("p", lambda x: F.array(*(x[f"f{i}"] for i in range(len(fields)))))).alias("v"))


def _by_size(batch, width: int):
    """(places, (groups, points, width) values) of the groups of each size in a batch."""
    n, v = batch.column("n").to_numpy(), batch.column("v")
    start = v.offsets.to_numpy()[:-1]
    values = v.values.to_numpy(zero_copy_only=False)
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        yield at, values[start[at][:, None] + np.arange(size * width)].reshape(len(at), size, width)


def object_poses(undistorted: DataFrame, least: int = 4) -> DataFrame:
    """Pose of each object before each camera in each frame.

    ``undistorted`` has und_x, und_y and obj_loc_*. A group is one object in one image, as
    small as the object; groups are gathered into rows, and one Arrow pass solves all
    groups of one size in a batch together.
    """
    keys = ("cam_id", "sync_index", "object_id")
    seen = undistorted.filter("obj_loc_x is not null and obj_loc_y is not null").withColumn("obj_loc_z", F.coalesce("obj_loc_z", F.lit(0.0)))
    groups = _views(seen, ("obj_loc_x", "obj_loc_y", "obj_loc_z", "und_x", "und_y"), keys, least)

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in _by_size(batch, 5):
                r, t, rmse, ok = solve_poses(x[:, :, :3], x[:, :, 3:])
                own = [batch.column(c).take(pa.array(at[ok])) for c in keys]
                arrays = [pa.FixedSizeListArray.from_arrays(pa.array(a[ok].reshape(-1)), k).cast(pa.list_(pa.float64())) for a, k in ((r, 9), (t, 3))]
                yield pa.record_batch([*own, *arrays, pa.array(rmse[ok]), pa.array(np.full(int(ok.sum()), x.shape[1]))], names=[*keys, "r", "t", "rmse", "n"])

    return groups.mapInArrow(solve, POSE)


def board_tilts(points: DataFrame, limit: float = 5.0, least: int = 4) -> DataFrame:
    """(cam_id, sync_index, object_id, direction, magnitude, rotation) of flat objects: how they lean,
    from the homography of their place in the object, scaled to [0, 1], to the image.

    Its perspective terms give direction (0 to 2 pi) and magnitude of the tilt, its affine
    part the turn in the image. A second fit leaves out points that the first one puts
    more than ``limit`` off, if four are left. Objects without a homography have no tilt (0, 0, 0).
    """
    keys = ("cam_id", "sync_index", "object_id")
    flat = points.filter("obj_loc_x is not null and obj_loc_y is not null and img_loc_x is not null and img_loc_y is not null")
    groups = _views(flat, ("obj_loc_x", "obj_loc_y", "img_loc_x", "img_loc_y"), keys, least)

    def solve(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in _by_size(batch, 4):
                lo, span = x[:, :, :2].min(axis=1, keepdims=True), np.ptp(x[:, :, :2], axis=1)[:, None]
                p = np.concatenate([(x[:, :, :2] - lo) / np.where(span < 1e-6, 1.0, span), np.ones((*x.shape[:2], 1))], axis=2)
                # Pixels around their middle, so that the system is well scaled.
                mid = x[:, :, 2:].mean(axis=1)
                size = np.maximum(np.abs(x[:, :, 2:] - mid[:, None]).max(axis=(1, 2)), 1e-12)
                image = (x[:, :, 2:] - mid[:, None]) / size[:, None, None]
                h = _projective(p, image)
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = np.einsum("gij,gnj->gni", h, p)
                    off = np.linalg.norm(seen[:, :, :2] / seen[:, :, 2:] - image, axis=2) * size[:, None]
                    good = off <= limit
                    again = (good.sum(axis=1) >= 4) & ~good.all(axis=1)
                    if again.any():
                        h[again] = _projective(p[again], image[again], good[again].astype(float))
                    back = np.zeros_like(h)
                    back[:, 0], back[:, 1], back[:, 2] = h[:, 0] * size[:, None] + h[:, 2] * mid[:, :1], h[:, 1] * size[:, None] + h[:, 2] * mid[:, 1:], h[:, 2]
                    h = back / back[:, 2:, 2:]
                none = ~np.isfinite(h).all(axis=(1, 2))
                h[none] = np.eye(3)
                u, _, vt = np.linalg.svd(h[:, :2, :2])
                turn = u @ vt
                full = 2 * np.pi
                found = np.arctan2(h[:, 2, 1], h[:, 2, 0]) % full, np.hypot(h[:, 2, 0], h[:, 2, 1]), np.arctan2(turn[:, 1, 0], turn[:, 0, 0]) % full
                yield pa.record_batch([*(batch.column(c).take(pa.array(at)) for c in keys), *(pa.array(np.where(none, 0.0, f)) for f in found)], names=[*keys, "direction", "magnitude", "rotation"])

    return groups.mapInArrow(solve, "cam_id long, sync_index long, object_id long, direction double, magnitude double, rotation double")


def relative_poses(poses: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_a, cam_b, sync_index, object_id, r, t): R_b R_a', t_b - R_b R_a' t_a, for a < b not ignored.

    The cameras of an object in a frame are gathered and paired within it.
    """
    allowed = cameras.filter("not coalesce(ignored, false)").select("cam_id")
    one = F.struct("cam_id", "r", "t")
    groups = poses.join(F.broadcast(allowed), "cam_id", "left_semi").groupBy("sync_index", "object_id").agg(F.array_sort(F.collect_list(one)).alias("v"))
    pairs = groups.select("sync_index", "object_id", "v", F.explode("v").alias("a")).select("sync_index", "object_id", "a", F.explode(F.expr("filter(v, x -> x.cam_id > a.cam_id)")).alias("b"))
    r = G.matmul(F.col("b.r"), F.col("a.r"), transpose_b=True)
    out = pairs.select(F.col("a.cam_id").alias("cam_a"), F.col("b.cam_id").alias("cam_b"), "sync_index", "object_id", r.alias("r"), F.col("a.t").alias("ta"), F.col("b.t").alias("tb"))
    moved = G.matvec(F.col("r"), F.col("ta"))
    return out.select("cam_a", "cam_b", "sync_index", "object_id", "r", F.zip_with("tb", moved, lambda x, y: x - y).alias("t"))


def quaternion(r: F.Column) -> F.Column:
    """(w, x, y, z) of a rotation, w not negative; from the largest of its four squares."""
    m = lambda i, j: F.element_at(r, 3 * i + j + 1)
    sq = [1 + m(0, 0) + m(1, 1) + m(2, 2), 1 + m(0, 0) - m(1, 1) - m(2, 2), 1 - m(0, 0) + m(1, 1) - m(2, 2), 1 - m(0, 0) - m(1, 1) + m(2, 2)]
    d = {(0, 1): m(2, 1) - m(1, 2), (0, 2): m(0, 2) - m(2, 0), (0, 3): m(1, 0) - m(0, 1), (1, 2): m(0, 1) + m(1, 0), (1, 3): m(0, 2) + m(2, 0), (2, 3): m(1, 2) + m(2, 1)}
    best = F.greatest(*sq)
    s = F.sqrt(F.greatest(best, F.lit(1e-30))) * 2
    rows = [F.array(*(s / 4 if i == k else d[tuple(sorted((i, k)))] / s for i in range(4))) for k in range(4)]
    q = F.when(sq[0] == best, rows[0]).when(sq[1] == best, rows[1]).when(sq[2] == best, rows[2]).otherwise(rows[3])
    return F.when(F.element_at(q, 1) < 0, F.transform(q, lambda v: -v)).otherwise(q)


def without_outlier_poses(relative: DataFrame, k: float = 1.5, least: int = 5) -> DataFrame:
    """Relative poses whose distance lies within the quartiles by ``k`` ranges and whose turn from the
    pair's mean is no higher; pairs with fewer than ``least`` poses pass.

    Quartiles are aggregates of each pair, joined back; pairs are as many as the rig allows.
    """
    keyed = relative.withColumn("_d", F.sqrt(F.aggregate("t", F.lit(0.0), lambda a, v: a + v * v)))
    mean = average_poses(relative).select("cam_a", "cam_b", F.col("r").alias("_mean"))
    keyed = keyed.join(F.broadcast(mean), ["cam_a", "cam_b"]).withColumn("_w", G.rotation_angle(G.matmul(F.col("r"), F.col("_mean"), transpose_b=True)))
    q = F.array(F.lit(0.25), F.lit(0.75))
    limits = keyed.groupBy("cam_a", "cam_b").agg(F.count("*").alias("_n"), F.percentile("_d", q).alias("_qd"), F.percentile("_w", q).alias("_qw"))
    out = keyed.join(F.broadcast(limits), ["cam_a", "cam_b"])
    lo, hi = F.col("_qd")[0], F.col("_qd")[1]
    good = F.col("_d").between(lo - k * (hi - lo), hi + k * (hi - lo)) & (F.col("_w") <= F.col("_qw")[1] + k * (F.col("_qw")[1] - F.col("_qw")[0]))
    return out.filter((F.col("_n") < least) | good).select(*relative.columns)


def average_poses(relative: DataFrame) -> DataFrame:
    """(cam_a, cam_b, r, t, n): mean translation, and the rotation whose quaternion is the top eigenvector
    of the sum of outer products: ten sums, and one small eigenproblem for each pair."""
    q = relative.withColumn("_q", quaternion(F.col("r")))
    at = lambda i: F.element_at("_q", i + 1)
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = q.groupBy("cam_a", "cam_b").agg(F.count("*").alias("n"), F.array(*(F.avg(F.element_at("t", i + 1)) for i in range(3))).alias("t"), *(F.sum(at(i) * at(j)).alias(f"m{i}{j}") for i, j in cells))

    def solve(batches):
        for pdf in batches:
            m = np.empty((len(pdf), 4, 4))
            for i, j in cells:
                m[:, i, j] = m[:, j, i] = pdf[f"m{i}{j}"]
            v = np.linalg.eigh(m)[1][:, :, 3] if len(pdf) else np.empty((0, 4))
            w, x, y, z = v.T
            r = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1)
            out = pdf[["cam_a", "cam_b", "t", "n"]].copy()
            out["r"] = list(r)
            yield out[["cam_a", "cam_b", "r", "t", "n"]]

    return sums.mapInPandas(solve, "cam_a long, cam_b long, r array<double>, t array<double>, n long")


@dataclass(frozen=True)
class Edge:
    """Pose of camera b before camera a, with a summed error."""

    r: np.ndarray
    t: np.ndarray
    error: float

    def inverse(self) -> Edge:
        return Edge(self.r.T, -self.r.T @ self.t, self.error)

    def then(self, after: Edge) -> Edge:
        return Edge(after.r @ self.r, after.r @ self.t + after.t, self.error + after.error)


class PoseGraph:
    """Relative poses between the cameras of a rig: driver-side, a rig has tens of cameras."""

    def __init__(self, edges: dict[tuple[int, int], Edge]) -> None:
        self.edges = dict(edges)
        for (a, b), e in edges.items():
            self.edges.setdefault((b, a), e.inverse())

    @classmethod
    def collect(cls, pairs: DataFrame) -> PoseGraph:
        """From (cam_a, cam_b, r, t, error): one row for each pair of cameras."""
        rows = pairs.select("cam_a", "cam_b", "r", "t", "error").collect()
        return cls({(x["cam_a"], x["cam_b"]): Edge(np.array(x["r"]).reshape(3, 3), np.array(x["t"]), x["error"]) for x in rows})

    @property
    def cameras(self) -> list[int]:
        return sorted({c for pair in self.edges for c in pair})

    def closed(self) -> PoseGraph:
        """With missing pairs bridged over the camera of least summed error, again and again; bridges
        that are found serve at once, in the order of the pairs."""
        edges, cams, changed = dict(self.edges), self.cameras, True
        while changed:
            changed = False
            for a in cams:
                for b in cams:
                    if a == b or (a, b) in edges:
                        continue
                    over = [edges[a, c].then(edges[c, b]) for c in cams if (a, c) in edges and (c, b) in edges]
                    if over:
                        best = min(over, key=lambda e: e.error)
                        edges[a, b], edges[b, a], changed = best, best.inverse(), True
        return PoseGraph(edges)

    def largest_group(self) -> list[int]:
        """The first of the largest connected groups."""
        left, best = set(self.cameras), []
        for start in self.cameras:
            if start not in left:
                continue
            group, todo = {start}, [start]
            while todo:
                at = todo.pop()
                new = {b for a, b in self.edges if a == at} - group
                group |= new
                todo += new
            left -= group
            if len(group) > len(best):
                best = sorted(group)
        return best

    def anchored(self) -> tuple[int, dict[int, Edge]]:
        """(anchor, pose of each camera): the anchor of least total error stands at the origin."""
        group, graph = self.largest_group(), self.closed()
        cost = {a: sum(graph.edges[a, b].error for b in group if b != a) for a in group}
        anchor = min(group, key=lambda c: (cost[c], c))
        poses = {b: graph.edges[anchor, b] for b in group if b != anchor}
        return anchor, {anchor: Edge(np.eye(3), np.zeros(3), 0.0), **poses}


def stereo_errors(correspondences: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cam_a, cam_b, rmse, n): points seen by two cameras, triangulated from their relative pose and
    projected back, in normalised units.

    ``correspondences``: x_a, y_a, x_b, y_b without distortion. Depths along both rays solve
    a 2x2 system in closed form, so that all of it is column arithmetic.
    """
    pose = pairs.select("cam_a", "cam_b", *(F.col("r")[i].alias(f"_r{i}") for i in range(9)), *(F.col("t")[i].alias(f"_t{i}") for i in range(3)))
    rows = correspondences.join(F.broadcast(pose), ["cam_a", "cam_b"])
    c = F.col
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), F.lit(0.0))
    # The ray of camera a in camera b, the ray of camera b, and the way between the cameras.
    rows = rows.withColumns({f"_d{i}": c(f"_r{3 * i}") * c("x_a") + c(f"_r{3 * i + 1}") * c("y_a") + c(f"_r{3 * i + 2}") for i in range(3)})
    d, e, t = [c(f"_d{i}") for i in range(3)], [c("x_b"), c("y_b"), F.lit(1.0)], [c(f"_t{i}") for i in range(3)]
    rows = rows.withColumns({"_dd": dot(d, d), "_de": dot(d, e), "_ee": dot(e, e), "_dt": dot(d, t), "_et": dot(e, t)})
    det = c("_dd") * c("_ee") - c("_de") * c("_de")
    rows = rows.withColumns({"_s": F.try_divide(c("_de") * c("_et") - c("_ee") * c("_dt"), det), "_u": F.try_divide(c("_dd") * c("_et") - c("_de") * c("_dt"), det)})
    # The middle of the shortest line between the rays, in camera b; back in camera a by R'.
    rows = rows.filter("_s > 0 and _u > 0").withColumns({f"_m{i}": ((d[i] * c("_s") + t[i]) + e[i] * c("_u")) / 2 for i in range(3)})
    rows = rows.withColumns({f"_p{i}": dot([c(f"_r{3 * k + i}") for k in range(3)], [c(f"_m{k}") - c(f"_t{k}") for k in range(3)]) for i in range(3)})
    off = lambda p, x, y: (c(f"{p}0") / c(f"{p}2") - c(x)) ** 2 + (c(f"{p}1") / c(f"{p}2") - c(y)) ** 2
    return rows.groupBy("cam_a", "cam_b").agg(F.sqrt(F.avg((off("_p", "x_a", "y_a") + off("_m", "x_b", "y_b")) / 2)).alias("rmse"), F.count("*").alias("n")).filter("n >= 4")


def pose_network(undistorted: DataFrame, cameras: DataFrame, correspondences: DataFrame) -> PoseGraph:
    """The whole chain: poses, relative poses, outliers, means, stereo errors, graph."""
    mean = average_poses(without_outlier_poses(relative_poses(object_poses(undistorted), cameras)))
    errors = stereo_errors(correspondences, mean).select("cam_a", "cam_b", F.col("rmse").alias("error"))
    return PoseGraph.collect(mean.join(errors, ["cam_a", "cam_b"]))


@dataclass(frozen=True)
class Similarity:
    """scale R x + t."""

    r: np.ndarray
    t: np.ndarray
    scale: float = 1.0

    def points(self, world: DataFrame) -> DataFrame:
        c = ("x_coord", "y_coord", "z_coord")
        new = {c[i]: sum((F.col(c[j]) * float(self.scale * self.r[i, j]) for j in range(3)), F.lit(float(self.t[i]))) for i in range(3)}
        return world.withColumns(new)

    def cameras(self, cams: DataFrame) -> DataFrame:
        """R' = R_c R^T, t' = -R' C' with the moved centre C'."""
        x, y, z = G.camera_centre()
        centre = [x, y, z]
        moved = cams.withColumns({f"_c{i}": sum((centre[j] * float(self.scale * self.r[i, j]) for j in range(3)), F.lit(float(self.t[i]))) for i in range(3)})
        turned = {f"_r{3 * i + j}": sum((F.col(f"r{3 * i + k}") * float(self.r[j, k]) for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)}
        moved = moved.withColumns(turned)
        new = {f"r{i}": F.col(f"_r{i}") for i in range(9)} | {f"t{i}": -sum((F.col(f"_r{3 * i + k}") * F.col(f"_c{k}") for k in range(3)), F.lit(0.0)) for i in range(3)}
        return moved.withColumns(new).select(*cams.columns)


def estimate_similarity(pairs: DataFrame, rigid: bool = False) -> Similarity:
    """The similarity that best takes (ax, ay, az) to (bx, by, bz), from sums; at least three pairs, no NaN."""
    a, b = ("ax", "ay", "az"), ("bx", "by", "bz")
    sums = pairs.agg(F.count("*").alias("n"), F.count_if(sum((F.col(c).isNull().cast("int") + F.isnan(c).cast("int") for c in a + b), F.lit(0)) > 0).alias("bad"), *(F.avg(c).alias(c) for c in a + b)).first()
    if sums["n"] < 3 or sums["bad"]:
        raise ValueError("a similarity needs three pairs of finite points")
    ma, mb = (np.array([sums[c] for c in k]) for k in (a, b))
    # Second pass around the means, so that large offsets cost no digits.
    da, db = [[F.col(c) - float(m) for c, m in zip(k, v)] for k, v in ((a, ma), (b, mb))]
    row = pairs.agg(*(F.avg(db[i] * da[j]).alias(f"c{i}{j}") for i in range(3) for j in range(3)), F.avg(sum((d * d for d in da), F.lit(0.0))).alias("va")).first()
    cov = np.array([[row[f"c{i}{j}"] for j in range(3)] for i in range(3)])
    u, s, vt = np.linalg.svd(cov)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ flip @ vt
    scale = 1.0 if rigid else float((s * np.diag(flip)).sum() / row["va"])
    return Similarity(r, mb - scale * r @ ma, scale)


def basis(up: np.ndarray, forward: np.ndarray) -> np.ndarray:
    """Rows X, Y, Z of a frame with z along ``up`` and y towards ``forward``; ValueError if they are parallel."""
    z = np.asarray(up, float) / np.linalg.norm(up)
    y = np.asarray(forward, float) - z * (np.asarray(forward, float) @ z)
    if np.linalg.norm(y) < 1e-9 * max(1.0, np.linalg.norm(forward)):
        raise ValueError("up and forward are parallel")
    y /= np.linalg.norm(y)
    return np.array([np.cross(y, z), y, z])


def turned(axis: str, degrees: float) -> Similarity:
    w = np.zeros(3)
    w["xyz".index(axis)] = np.radians(degrees)
    return Similarity(_turn(w), np.zeros(3))


def scaled(factor: float) -> Similarity:
    return Similarity(np.eye(3), np.zeros(3), factor)


def shifted(x: float, y: float, z: float) -> Similarity:
    return Similarity(np.eye(3), np.array([x, y, z], float))


def grounded(world: DataFrame) -> Similarity:
    """Brings the floor to height 0."""
    from sightline.operators.quality import floor_height

    return shifted(0, 0, -floor_height(world).first()["floor"])


def centred(cameras: DataFrame) -> Similarity:
    """Brings the middle of the cameras above the origin."""
    from sightline.operators.quality import camera_centroid

    c = camera_centroid(cameras).first()
    return shifted(-c["x"], -c["y"], 0)


def align_to_object(points: DataFrame, world: DataFrame, object_id: int, sync_index: int | None = None) -> Similarity:
    """Brings an object (in one frame, or over all) to its own coordinates."""
    from sightline.operators.quality import object_frames

    rows = object_frames(points.filter(F.col("object_id") == object_id), world)
    if sync_index is not None:
        rows = rows.filter(F.col("sync_index") == sync_index)
    return estimate_similarity(rows.select(F.col("x_coord").alias("ax"), F.col("y_coord").alias("ay"), F.col("z_coord").alias("az"), F.col("ox").alias("bx"), F.col("oy").alias("by"), F.col("oz").alias("bz")))


def pose_spread(relative: DataFrame) -> DataFrame:
    """(cam_a, cam_b, sync_index, turn): degrees of each relative pose from the one before it in time."""
    w = Window.partitionBy("cam_a", "cam_b", "object_id").orderBy("sync_index")
    before = relative.withColumn("_r", F.lag("r").over(w)).filter("_r is not null")
    return before.select("cam_a", "cam_b", "sync_index", "object_id", G.rotation_angle(G.matmul(F.col("r"), F.col("_r"), transpose_b=True)).alias("turn"))


def posed_centres(cameras: DataFrame) -> DataFrame:
    x, y, z = G.camera_centre()
    return posed(cameras).select("cam_id", x.alias("x"), y.alias("y"), z.alias("z"))
