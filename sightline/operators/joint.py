"""Bundle adjustment that also moves lenses and holds known distances, with bounds and a robust loss.

Distances couple points, so not single points are eliminated but rigid groups: the points of
one frame that distances connect, directly or over others. A group is one row; its size is
bounded by the table of distances, which is configuration. Points without distances are
groups of one. Each round is one pass that moves the groups and one that sums up what is
left for the cameras: nine numbers for each (turn, move, factor of the focal lengths, k1, k2).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.filters import collapse_static, posed
from sightline.schema import CAMERAS, WORLD_KEY
from sightline.sources.checkpoints import use_checkpoints

XYZ = ("x_coord", "y_coord", "z_coord")
POINT = ("object_id", "keypoint_id")
#: Parameters of a camera: a turn and a move, then the factor of both focal lengths, k1 and k2.
SIZE = 9
#: Least and greatest factor, k1 and k2, and how near to one of them is reported (of the factor, relatively).
LEAST, GREATEST, NEAR = (0.5, -1.0, -2.0), (2.0, 1.0, 2.0), 0.01
#: Numbers in the blocks of groups that a task holds at once.
CELLS = 1 << 22
#: Groups whose observations a task holds as arrays at once.
GROUPS = 512
#: Distances that are sent to all tasks at most; more are no configuration.
MOST_DISTANCES = 1 << 16


@dataclass(frozen=True)
class Cameras:
    """Poses and lenses by place in the list of camera ids; ``free``: whose lens moves."""

    ids: np.ndarray
    r: np.ndarray
    t: np.ndarray
    lens: np.ndarray  # fx, fy, cx, cy, p1, p2, k3 as given
    moving: np.ndarray  # factor, k1, k2
    fisheye: np.ndarray
    free: np.ndarray

    @classmethod
    def collect(cls, cameras: DataFrame, lenses: bool) -> Cameras:
        rows = posed(cameras).filter("fx is not null").orderBy("cam_id").collect()
        col = lambda *names: np.array([[float(c[n] or 0.0) for n in names] for c in rows]).reshape(len(rows), len(names))
        fisheye = np.array([bool(c["fisheye"]) for c in rows], bool)
        moving = np.column_stack([np.ones(len(rows)), col("k1", "k2")])
        return cls(
            np.array([c["cam_id"] for c in rows], np.int64), col(*(f"r{i}" for i in range(9))).reshape(-1, 3, 3), col("t0", "t1", "t2"),
            col("fx", "fy", "cx", "cy", "p1", "p2", "k3"), moving, fisheye, ~fisheye & lenses,
        )

    def moved(self, step: np.ndarray) -> Cameras:
        from sightline.operators.poses import _turn

        s = step.reshape(-1, SIZE)
        r = np.array([_turn(w) @ m for w, m in zip(s[:, :3], self.r)]).reshape(-1, 3, 3)
        return replace(self, r=r, t=self.t + s[:, 3:6], moving=self.moving + s[:, 6:])


@dataclass(frozen=True)
class NearBound:
    cam_id: int
    parameter: str
    value: float
    bound: float


@dataclass(frozen=True)
class Result:
    """``cost``: half the summed loss, in square pixels. ``distance_rmse``: of the distances, in their unit, None without any."""

    world: DataFrame
    cameras: DataFrame
    rmse_before: float
    rmse: float
    distance_rmse: float | None
    cost: float
    rounds: int
    converged: bool
    near_bounds: tuple[NearBound, ...]


def _pixels(k: Cameras, cam: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of points ``x`` in their cameras, and how these change with a camera (n, 2, SIZE) and with the point (n, 2, 3)."""
    turned = np.einsum("nij,nj->ni", k.r[cam], x)
    c = turned + k.t[cam]
    iz = 1 / c[:, 2]
    a, b = c[:, 0] * iz, c[:, 1] * iz
    fx, fy, cx, cy, p1, p2, k3 = k.lens[cam].T
    s, k1, k2 = k.moving[cam].T
    round_ = k.fisheye[cam]
    q = a * a + b * b
    radial = 1 + q * (k1 + q * (k2 + q * k3))
    slope = k1 + q * (2 * k2 + 3 * q * k3)
    if round_.any():
        r = np.maximum(np.sqrt(q), 1e-9)
        t2 = np.arctan(r) ** 2
        bent = np.sqrt(t2) * (1 + t2 * (k1 + t2 * (k2 + t2 * (p1 + t2 * p2))))
        rate = (1 + t2 * (3 * k1 + t2 * (5 * k2 + t2 * (7 * p1 + t2 * 9 * p2)))) / (1 + q)
        radial = np.where(round_, bent / r, radial)
        slope = np.where(round_, (rate - bent / r) / (2 * r * r), slope)
        p1, p2 = np.where(round_, 0.0, p1), np.where(round_, 0.0, p2)
    xd = a * radial + 2 * p1 * a * b + p2 * (q + 2 * a * a)
    yd = b * radial + p1 * (q + 2 * b * b) + 2 * p2 * a * b
    cross = 2 * a * b * slope + 2 * p1 * a + 2 * p2 * b
    bend = np.stack([np.stack([radial + 2 * a * a * slope + 2 * p1 * b + 6 * p2 * a, cross], 1), np.stack([cross, radial + 2 * b * b * slope + 6 * p1 * b + 2 * p2 * a], 1)], 1)
    zero = np.zeros_like(a)
    flat = np.stack([np.stack([iz, zero, -a * iz], 1), np.stack([zero, iz, -b * iz], 1)], 1)
    f = s[:, None] * np.stack([fx, fy], 1)
    d = f[:, :, None] * (bend @ flat)
    at, plain = np.stack([xd, yd], 1), np.stack([a, b], 1)
    lens = np.stack([at * np.stack([fx, fy], 1), f * plain * q[:, None], f * plain * (q * q)[:, None]], 2) * k.free[cam][:, None, None]
    return f * at + np.stack([cx, cy], 1), np.concatenate([np.cross(turned[:, None, :], d), d, lens], 2), d @ k.r[cam]


def _loss(z: np.ndarray, robust: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight and loss of residuals: squares, or from ``robust`` pixels on as soft L1."""
    if robust is None:
        return np.ones_like(z), z * z
    root = np.sqrt(1 + (z / robust) ** 2)
    return 1 / root, 2 * robust**2 * (root - 1)


@dataclass(frozen=True)
class Groups:
    """A batch flattened: points by group, observations and distances by point."""

    of: np.ndarray
    place: np.ndarray
    size: np.ndarray
    x: np.ndarray
    seen_by: np.ndarray
    camera: np.ndarray
    pixel: np.ndarray
    count: np.ndarray
    first: np.ndarray
    second: np.ndarray
    distance: np.ndarray
    weight: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, ids: np.ndarray, distances) -> Groups:
        import pandas as pd

        members = batch.column("members")
        size = members.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        of, flat = np.repeat(np.arange(len(size)), size), members.flatten()
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        obs = flat.field("obs")
        seen_by = np.repeat(np.arange(len(of)), obs.value_lengths().to_numpy(zero_copy_only=False))
        rows = obs.flatten()
        number = lambda s, n: s.field(n).to_numpy(zero_copy_only=False)
        keys = pd.DataFrame({"g": of, "o": number(flat, "object_id"), "k": number(flat, "keypoint_id"), "at": np.arange(len(of))})
        keys = keys[size[of] > 1]
        both = keys.rename(columns={"o": "oa", "k": "ka", "at": "a"}).merge(distances, on=["oa", "ka"]).merge(keys.rename(columns={"o": "ob", "k": "kb", "at": "b"}), on=["g", "ob", "kb"])
        return cls(
            of, place, size, np.stack([number(flat, c) for c in XYZ], 1), seen_by, np.searchsorted(ids, number(rows, "cam_id")), np.stack([number(rows, "u"), number(rows, "v")], 1),
            number(rows, "n"), both["a"].to_numpy(np.int64), both["b"].to_numpy(np.int64), both["distance"].to_numpy(float), both["weight"].to_numpy(float),
        )


@dataclass(frozen=True)
class Terms:
    """What a batch adds: blocks of cameras, and of groups of one size the blocks that eliminate them."""

    s: np.ndarray
    g: np.ndarray
    sums: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # groups' points, inverse, right side, coupling


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of GROUPS groups at most, so that what a task holds doesn't grow with its rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, GROUPS):
            yield batch.slice(lo, GROUPS)


def _terms(b: Groups, k: Cameras, damping: float, robust: float | None) -> Terms:
    n_cam = len(k.ids)
    pixel, jc, jp = _pixels(k, b.camera, b.x[b.seen_by])
    res = pixel - b.pixel
    weight, loss = _loss(res, robust)
    weight = weight * b.count[:, None]
    s, g = np.zeros((n_cam, SIZE, SIZE)), np.zeros((n_cam, SIZE))
    np.add.at(s, b.camera, np.einsum("nki,nkj,nk->nij", jc, jc, weight))
    np.add.at(g, b.camera, np.einsum("nki,nk->ni", jc, res * weight))
    apart = b.x[b.first] - b.x[b.second]
    length = np.sqrt((apart**2).sum(1))
    off = (length - b.distance) * b.weight
    w_off, loss_off = _loss(off, robust)
    along = apart / np.maximum(length, 1e-12)[:, None] * b.weight[:, None]
    sums = np.array([(loss * b.count[:, None]).sum() + loss_off.sum(), ((res**2).sum(1) * b.count).sum(), b.count.sum(), ((length - b.distance) ** 2).sum(), len(off)])
    vp, gp = np.zeros((len(b.x), 3, 3)), np.zeros((len(b.x), 3))
    np.add.at(vp, b.seen_by, np.einsum("nki,nkj,nk->nij", jp, jp, weight))
    np.add.at(gp, b.seen_by, np.einsum("nki,nk->ni", jp, res * weight))
    mp = np.zeros((len(b.x), n_cam, SIZE, 3))
    np.add.at(mp, (b.seen_by, b.camera), np.einsum("nki,nkj,nk->nij", jc, jp, weight))
    rank = np.einsum("ni,nj,n->nij", along, along, w_off)
    for end, sign in ((b.first, 1.0), (b.second, -1.0)):
        np.add.at(vp, end, rank)
        np.add.at(gp, end, sign * along * (off * w_off)[:, None])
    start, parts = np.cumsum(b.size) - b.size, []
    for m in np.unique(b.size):
        groups = np.flatnonzero(b.size == m)
        step = max(1, CELLS // int(3 * m * (3 * m + SIZE * n_cam)))
        for lo in range(0, len(groups), step):
            some = groups[lo : lo + step]
            points = start[some][:, None] + np.arange(m)
            v = np.zeros((len(some), m, 3, m, 3))
            at = np.arange(m)
            v[:, at, :, at, :] = vp[points].transpose(1, 0, 2, 3)
            number = np.full(len(b.size), -1)
            number[some] = np.arange(len(some))
            own = np.flatnonzero(number[b.of[b.first]] >= 0)
            i, p, q = number[b.of[b.first[own]]], b.place[b.first[own]], b.place[b.second[own]]
            np.add.at(v, (i, p, slice(None), q), -rank[own])
            np.add.at(v, (i, q, slice(None), p), -rank[own])
            v = v.reshape(len(some), 3 * m, 3 * m)
            diagonal = np.einsum("gii->gi", v)
            diagonal += damping * diagonal + 1e-12
            coupling = mp[points].transpose(0, 2, 3, 1, 4).reshape(len(some), n_cam * SIZE, 3 * m)
            parts.append((points, np.linalg.inv(v), gp[points].reshape(len(some), 3 * m), coupling))
    return Terms(s, g.reshape(-1), sums, parts)


def _system(rows: DataFrame, k: Cameras, distances, damping: float, robust: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The system of the cameras, its right side, and the sums of losses and errors."""
    shared, size = rows.sparkSession.sparkContext.broadcast((k, distances)), SIZE * len(k.ids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, distances = shared.value
        total = np.zeros(size * size + size + 5)
        for batch in _slices(batches):
            if batch.num_rows:
                found = _terms(Groups.read(batch, k.ids, distances), k, damping, robust)
                full, right = np.zeros((size, size)), found.g.copy()
                for c in range(len(k.ids)):
                    full[SIZE * c : SIZE * (c + 1), SIZE * c : SIZE * (c + 1)] = found.s[c]
                for _, inverse, gp, coupling in found.parts:
                    left = coupling @ inverse
                    full -= np.tensordot(left, coupling, ((0, 2), (0, 2)))
                    right -= np.einsum("gik,gk->i", left, gp)
                total += np.concatenate([full.reshape(-1), right, found.sums])
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    out = np.zeros(size * size + size + 5)
    for r in rows.select("members").mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    shared.unpersist()
    return out[: size * size].reshape(size, size), out[size * size : -5], out[-5:]


def _move(rows: DataFrame, k: Cameras, distances, step: np.ndarray, damping: float, robust: float | None) -> DataFrame:
    """The groups at the places that fit the cameras' ``step`` best."""
    shared = rows.sparkSession.sparkContext.broadcast((k, distances))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, distances = shared.value
        for batch in _slices(batches):
            if not batch.num_rows:
                continue
            b = Groups.read(batch, k.ids, distances)
            x = b.x.copy()
            for points, inverse, gp, coupling in _terms(b, k, damping, robust).parts:
                x[points] -= np.einsum("gij,gj->gi", inverse, gp + np.einsum("gik,i->gk", coupling, step)).reshape(*points.shape, 3)
            members, flat = batch.column("members"), batch.column("members").flatten()
            fields = {n: flat.field(n) for n in (*POINT, *XYZ, "obs")} | {c: pa.array(x[:, i]) for i, c in enumerate(XYZ)}
            moved = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
            offsets = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.record_batch([batch.column("sync_index"), pa.ListArray.from_arrays(pa.array(offsets), moved)], names=["sync_index", "members"])

    return rows.mapInArrow(work, rows.schema)


def _step(s: np.ndarray, g: np.ndarray, k: Cameras, damping: float) -> np.ndarray:
    """The damped step of the cameras within the bounds. The first camera's pose stays; what lies at a bound and would leave it does, too."""
    low = np.tile([*[-np.inf] * 6, *LEAST], len(k.ids)) - np.column_stack([np.zeros((len(k.ids), 6)), k.moving]).reshape(-1)
    high = np.tile([*[np.inf] * 6, *GREATEST], len(k.ids)) - np.column_stack([np.zeros((len(k.ids), 6)), k.moving]).reshape(-1)
    free = np.column_stack([np.ones((len(k.ids), 6), bool), np.repeat(k.free[:, None], 3, 1)]).reshape(-1)
    free[:6] = False
    free &= ~((low >= 0) & (g > 0)) & ~((high <= 0) & (g < 0))
    out = np.zeros(len(g))
    while free.any():
        a = s[np.ix_(free, free)]
        a = a + damping * np.diag(np.diag(a))
        scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
        # What is held at a bound moves the others by what it adds to their right side.
        right = -g[free] - s[np.ix_(free, ~free)] @ out[~free]
        out[free] = scale * np.linalg.lstsq(a * np.outer(scale, scale), scale * right, rcond=None)[0]
        beyond = free & ((out < low) | (out > high))
        if not beyond.any():
            break
        out[beyond] = np.clip(out, low, high)[beyond]
        free &= ~beyond
    return out


def _units(spark: SparkSession, distances) -> DataFrame:
    """(object_id, keypoint_id, unit): the points that distances connect."""
    of: dict = {}

    def root(p):
        while of.setdefault(p, p) != p:
            of[p] = p = of[of[p]]
        return p

    for oa, ka, ob, kb in zip(*(distances[c] for c in ("oa", "ka", "ob", "kb"))):
        of[root((int(oa), int(ka)))] = root((int(ob), int(kb)))
    names = {p: i for i, p in enumerate(sorted({root(p) for p in list(of)}))}
    return spark.createDataFrame([(*p, names[root(p)]) for p in sorted(of)], "object_id long, keypoint_id long, unit long")


def _near_bounds(k: Cameras) -> tuple[NearBound, ...]:
    out = []
    for c in np.flatnonzero(k.free):
        for i, name in enumerate(("factor", "k1", "k2")):
            for bound in (LEAST[i], GREATEST[i]):
                if abs(k.moving[c, i] - bound) <= NEAR * (bound if i == 0 else 1.0):
                    out.append(NearBound(int(k.ids[c]), name, float(k.moving[c, i]), bound))
    return tuple(out)


def adjust(
    points: DataFrame, world: DataFrame, cameras: DataFrame, distances: DataFrame | None = None, static_objects: Iterable[int] = (), *,
    lenses: bool = False, pixel_sigma: float = 1.0, robust: float | None = None, rounds: int = 30, settle: float = 1e-10,
) -> Result:
    """Cameras, points and, with ``lenses``, focal lengths, k1 and k2 that best explain pixels and distances.

    ``distances``: object_id_a, keypoint_id_a, object_id_b, keypoint_id_b, distance, sigma, as
    ``constraints.marker_constraints`` gives them; each holds in every frame that has both
    points, its error counts pixel_sigma / sigma pixels a unit. fx and fy keep their ratio; p1, p2, k3
    and fisheye lenses stay. ``robust``: soft L1 from so many pixels on. Pixels and distances without
    a value, points behind no or one camera and cameras without pose or lens are left out; repeated
    observations of a point in a camera are averaged. Distances of a point to itself or without a positive sigma
    are left out, repeated ones count each. Nothing to adjust gives an empty world and the cameras as they are.
    """
    import pandas as pd

    spark = points.sparkSession
    use_checkpoints(spark)
    known = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("oa", "ka", "ob", "kb")} | {c: np.zeros(0) for c in ("distance", "weight")})
    if distances is not None:
        wanted = distances.filter("distance is not null and sigma > 0 and (object_id_a <> object_id_b or keypoint_id_a <> keypoint_id_b)")
        rows = wanted.select(F.col("object_id_a").alias("oa"), F.col("keypoint_id_a").alias("ka"), F.col("object_id_b").alias("ob"), F.col("keypoint_id_b").alias("kb"), F.col("distance").cast("double"), F.try_divide(F.lit(float(pixel_sigma)), F.col("sigma")).alias("weight")).limit(MOST_DISTANCES + 1).toPandas()
        if len(rows) > MOST_DISTANCES:
            raise ValueError(f"over {MOST_DISTANCES} distances: they are sent to every task")
        known = rows.astype({"distance": float, "weight": float}) if len(rows) else known
    k = Cameras.collect(cameras, lenses)
    own = F.broadcast(spark.createDataFrame([(int(c),) for c in k.ids], "cam_id long"))
    seen = collapse_static(points.filter("not isnan(img_loc_x) and not isnan(img_loc_y)").join(own, "cam_id", "left_semi"), static_objects)
    means = seen.groupBy(*WORLD_KEY, "cam_id").agg(F.avg("img_loc_x").alias("u"), F.avg("img_loc_y").alias("v"), F.count("*").cast("double").alias("n"))
    obs = means.groupBy(*WORLD_KEY).agg(F.array_sort(F.collect_list(F.struct("cam_id", "u", "v", "n"))).alias("obs")).filter(F.size("obs") > 1)
    placed = world.select(*WORLD_KEY, *XYZ).dropna().join(obs, list(WORLD_KEY))
    member = F.struct(*POINT, *XYZ, "obs")
    if len(known):
        units = placed.join(F.broadcast(_units(spark, known)), list(POINT), "left")
        # Of points without distances each is a unit of its own.
        alone = F.when(F.col("unit").isNull(), F.struct(*POINT))
        rows = units.groupBy("sync_index", "unit", alone.alias("alone")).agg(F.array_sort(F.collect_list(member)).alias("members")).select("sync_index", "members")
    else:
        rows = placed.select("sync_index", F.array(member).alias("members"))
    rows = rows.checkpoint()
    damping = 1e-4
    s, g, sums = _system(rows, k, known, damping, robust)
    before, done, converged = sums, 0, not sums[2]
    while done < rounds and not converged:
        done += 1
        step = _step(s, g, k, damping)
        new_k = k.moved(step)
        new_rows = _move(rows, k, known, step, damping, robust).checkpoint()
        new = _system(new_rows, new_k, known, damping / 10, robust)
        if new[2][0] < sums[0]:
            converged = sums[0] - new[2][0] <= settle * sums[0] or new[2][0] <= 1e-16 * sums[2]
            rows, k, damping, (s, g, sums) = new_rows, new_k, damping / 10, new
        elif damping > 1e8 or np.isclose(new[2][0], sums[0], rtol=settle, atol=0):
            converged = damping <= 1e8
            break
        else:
            damping *= 10
            s, g, _ = _system(rows, k, known, damping, robust)
    names = (*(f"r{i}" for i in range(9)), "t0", "t1", "t2", "fx", "fy", "k1", "k2")
    values = np.column_stack([k.r.reshape(-1, 9), k.t, k.lens[:, :2] * k.moving[:, :1], k.moving[:, 1:]])
    found = spark.createDataFrame([(int(c), *map(float, v)) for c, v in zip(k.ids, values)], "cam_id long, " + ", ".join(f"_{n} double" for n in names))
    moved = cameras.join(F.broadcast(found), "cam_id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in CAMERAS.names))
    out = rows.select("sync_index", F.inline("members")).select(*WORLD_KEY, *XYZ)
    rmse = lambda x: float(np.sqrt(x[1] / max(x[2], 1.0)))
    apart = float(np.sqrt(sums[3] / sums[4])) if sums[4] else None
    return Result(out, moved, rmse(before), rmse(sums), apart, float(sums[0] / 2), done, bool(converged), _near_bounds(k))
