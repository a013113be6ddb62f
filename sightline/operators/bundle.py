"""Bundle adjustment: all cameras and points at once, by damped least squares with the points eliminated.

Each round is one pass over points: a point's observations, as many as the rig has cameras,
stand in one row; each Arrow batch forms the blocks of its points, eliminates them, and
adds what is left to a system over the cameras alone, which Spark sums up. The driver
solves this system of six rows for each camera; a second pass moves the points, and puts each at
its best place before the moved cameras: near the line between two cameras that alone see a
point its depth is hardly fixed, and one such point would hold up the steps of all others.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.filters import collapse_static, posed
from sightline.operators.reconstruction import undistort
from sightline.schema import CAMERAS, WORLD_KEY
from sightline.sources.checkpoints import use_checkpoints

XYZ = ("x_coord", "y_coord", "z_coord")


@dataclass(frozen=True)
class Rig:
    """Poses by place in the list of camera ids."""

    ids: tuple[int, ...]
    r: np.ndarray
    t: np.ndarray
    f: np.ndarray

    @classmethod
    def collect(cls, cameras: DataFrame) -> Rig:
        rows = posed(cameras).orderBy("cam_id").collect()
        r = np.array([[c[f"r{i}"] for i in range(9)] for c in rows]).reshape(-1, 3, 3)
        return cls(tuple(c["cam_id"] for c in rows), r, np.array([[c[f"t{i}"] for i in range(3)] for c in rows]), np.array([c["fx"] for c in rows]))

    def moved(self, step: np.ndarray) -> Rig:
        from sightline.operators.poses import _turn

        s = step.reshape(-1, 6)
        return Rig(self.ids, np.array([_turn(w) @ r for w, r in zip(s[:, :3], self.r)]), self.t + s[:, 3:], self.f)


@dataclass(frozen=True)
class Result:
    world: DataFrame
    cameras: DataFrame
    rmse_before: float
    rmse: float
    rounds: int


#: Own steps of a point after each step of the cameras.
POINT_STEPS = 8


@dataclass(frozen=True)
class Seen:
    """A batch's observations, flattened: place of the point in the batch, of the camera in the rig, where and how often."""

    p: np.ndarray
    cam: np.ndarray
    at: np.ndarray
    n: np.ndarray

    @classmethod
    def read(cls, pdf, rig: Rig) -> Seen:
        flat = [o for obs in pdf["obs"] for o in obs]
        place = {c: i for i, c in enumerate(rig.ids)}
        x, y, n = (np.array([o[k] for o in flat], dtype=float) for k in ("x", "y", "n"))
        return cls(np.repeat(np.arange(len(pdf)), pdf["obs"].map(len).to_numpy()), np.array([place[o["cam_id"]] for o in flat], dtype=int), np.stack([x, y], 1), n)

    def residuals(self, rig: Rig, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(residuals in pixels, how they change with the point before the camera, the turned points) of points ``x``."""
        turned = np.einsum("oij,oj->oi", rig.r[self.cam], x[self.p])
        c = turned + rig.t[self.cam]
        a, b, iz = c[:, 0] / c[:, 2], c[:, 1] / c[:, 2], 1 / c[:, 2]
        zero, f = np.zeros_like(iz), rig.f[self.cam]
        d = np.stack([np.stack([iz, zero, -a * iz], 1), np.stack([zero, iz, -b * iz], 1)], axis=1) * f[:, None, None]
        return (np.stack([a, b], 1) - self.at) * f[:, None], d, turned


def _loss(res: np.ndarray, n: np.ndarray, robust: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(weight, loss) of each observation: squares, or from ``robust`` pixels on as soft L1."""
    q = (res**2).sum(1)
    if robust is None:
        return n, n * q
    root = np.sqrt(1 + q / robust**2)
    return n / root, n * 2 * robust**2 * (root - 1)


def _intersected(k: Seen, rig: Rig, points: int) -> np.ndarray:
    """Points where the lines of sight meet best, by the linear equations of triangulation."""
    rows = np.concatenate([rig.r, rig.t[:, :, None]], axis=2)[k.cam]
    lines = k.at[:, :, None] * rows[:, None, 2] - rows[:, :2]
    m = np.zeros((points, 4, 4))
    np.add.at(m, k.p, np.einsum("oki,okj,o->oij", lines, lines, k.n))
    v = np.linalg.eigh(m)[1][:, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return v[:, :3] / v[:, 3:]


def _settled(k: Seen, rig: Rig, x: np.ndarray, robust: float | None) -> np.ndarray:
    """Each point at its best place before these cameras, from ``x`` or where its lines of sight meet; never a worse one."""

    def cost(at: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            loss = np.bincount(k.p, _loss(k.residuals(rig, at)[0], k.n, robust)[1], len(at))
        return np.where(np.isfinite(loss), loss, np.inf)

    def better(old: np.ndarray, old_cost: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new_cost = cost(new)
        gain = new_cost < old_cost
        return np.where(gain[:, None], new, old), np.where(gain, new_cost, old_cost), gain

    x, now, _ = better(x, cost(x), _intersected(k, rig, len(x)))
    damping = np.full(len(x), 1e-6)
    for _ in range(POINT_STEPS):
        with np.errstate(all="ignore"):
            res, d, _ = k.residuals(rig, x)
            w, jp = _loss(res, k.n, robust)[0], d @ rig.r[k.cam]
            v, g = np.zeros((len(x), 3, 3)), np.zeros((len(x), 3))
            np.add.at(v, k.p, np.einsum("oki,okj,o->oij", jp, jp, w))
            np.add.at(g, k.p, np.einsum("oki,ok,o->oi", jp, res, w))
            v += np.eye(3) * (damping * np.einsum("pii->p", v) / 3 + 1e-12)[:, None, None]
            good = np.isfinite(v).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
            step = np.zeros_like(x)
            step[good] = np.einsum("pij,pj->pi", np.linalg.inv(v[good]), g[good])
        x, now, gain = better(x, now, x - step)
        damping = np.where(gain, damping / 10, damping * 10)
    return x


def _blocks(k: Seen, x: np.ndarray, rig: Rig, damping: float, robust: float | None) -> dict[str, np.ndarray]:
    """Residuals and Jacobian blocks of a batch of points at ``x``."""
    p, cam, n = k.p, k.cam, k.n
    res, d, turned = k.residuals(rig, x)
    w, loss = _loss(res, n, robust)
    jc = np.concatenate([np.cross(turned[:, None, :], d), d], axis=2)
    jp = d @ rig.r[cam]
    v = np.zeros((len(x), 3, 3))
    gp = np.zeros((len(x), 3))
    np.add.at(v, p, np.einsum("oki,okj,o->oij", jp, jp, w))
    np.add.at(gp, p, np.einsum("oki,ok,o->oi", jp, res, w))
    m = np.zeros((len(x), len(rig.ids), 6, 3))
    np.add.at(m, (p, cam), np.einsum("oki,okj,o->oij", jc, jp, w))
    v += np.eye(3) * (damping * np.einsum("pii->p", v) / 3 + 1e-12)[:, None, None]
    return {"cam": cam, "jc": jc, "res": res, "w": w, "n": n, "loss": loss, "inv": np.linalg.inv(v), "gp": gp, "m": m.reshape(len(x), -1, 3)}


def _system(rows: DataFrame, rig: Rig, damping: float, robust: float | None) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """The camera system, its right side, the summed loss, the summed squared error and the number of observations."""
    shared, size = rows.sparkSession.sparkContext.broadcast(rig), 6 * len(rig.ids)

    def work(batches):
        import pandas as pd

        total = np.zeros(size * size + size + 3)
        for pdf in batches:
            if not len(pdf):
                continue
            rig = shared.value
            k = _blocks(Seen.read(pdf, rig), pdf[list(XYZ)].to_numpy(float), rig, damping, robust)
            s = np.zeros((len(rig.ids), 6, 6))
            g = np.zeros((len(rig.ids), 6))
            np.add.at(s, k["cam"], np.einsum("oki,okj,o->oij", k["jc"], k["jc"], k["w"]))
            np.add.at(g, k["cam"], np.einsum("oki,ok,o->oi", k["jc"], k["res"], k["w"]))
            left = np.einsum("pij,pjk->pik", k["m"], k["inv"])
            full = -np.einsum("pik,pjk->ij", left, k["m"])
            for i in range(len(rig.ids)):
                full[6 * i : 6 * i + 6, 6 * i : 6 * i + 6] += s[i]
            right = g.reshape(-1) - np.einsum("pik,pk->i", left, k["gp"])
            total += np.concatenate([full.reshape(-1), right, [k["loss"].sum(), (k["n"] * (k["res"] ** 2).sum(1)).sum(), k["n"].sum()]])
        yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = rows.mapInPandas(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * size + size + 3)
    for r in sums:
        out[r["i"]] = r["v"]
    return out[: size * size].reshape(size, size), out[size * size : -3], out[-3], out[-2], out[-1]


def _move_points(rows: DataFrame, rig: Rig, step: np.ndarray, damping: float, robust: float | None) -> DataFrame:
    """The points where they go with the cameras' ``step``, and from there to their best places before the moved cameras."""
    shared = rows.sparkSession.sparkContext.broadcast((rig, rig.moved(step), step))

    def work(batches):
        for pdf in batches:
            if len(pdf):
                rig, moved, step = shared.value
                seen, x = Seen.read(pdf, rig), pdf[list(XYZ)].to_numpy(float)
                if step.any():
                    k = _blocks(seen, x, rig, damping, robust)
                    x = x - np.einsum("pij,pj->pi", k["inv"], k["gp"] + np.einsum("pik,i->pk", k["m"], step))
                pdf = pdf.copy()
                pdf[list(XYZ)] = _settled(seen, moved, x, robust)
            yield pdf

    return rows.mapInPandas(work, rows.schema)


def adjust(points: DataFrame, world: DataFrame, cameras: DataFrame, static_objects: Iterable[int] = (), rounds: int = 10, robust: float | None = None, settle: float = 1e-8) -> Result:
    """Cameras and points that best explain the observations; errors are in pixels of the focal length.

    The first camera stays where it is. Observations of one point in one camera (a static
    point's many frames) are averaged first, which leaves the least squares the same.
    ``robust``: pixels from which errors weigh less. Points that one camera alone sees are
    left out of the solution and of the result.
    """
    spark = points.sparkSession
    use_checkpoints(spark)
    seen = collapse_static(undistort(points, posed(cameras)), static_objects)
    means = seen.groupBy(*WORLD_KEY, "cam_id").agg(F.avg("und_x").alias("x"), F.avg("und_y").alias("y"), F.count("*").cast("double").alias("n"))
    obs = means.groupBy(*WORLD_KEY).agg(F.array_sort(F.collect_list(F.struct("cam_id", "x", "y", "n"))).alias("obs")).filter(F.size("obs") > 1)
    rows = world.select(*WORLD_KEY, *XYZ).join(obs, list(WORLD_KEY)).checkpoint()
    rig, damping = Rig.collect(cameras), 1e-4
    before, done = _system(rows, rig, damping, robust)[3], 0
    rows = _move_points(rows, rig, np.zeros(6 * len(rig.ids)), damping, robust).checkpoint()
    s, g, cost, squares, n = _system(rows, rig, damping, robust)
    for done in range(1, rounds + 1):
        free = slice(6, None)
        a = s[free, free] + damping * np.diag(np.diag(s[free, free]))
        step = np.zeros(len(g))
        step[free] = np.linalg.lstsq(a, -g[free], rcond=None)[0]
        new_rows = _move_points(rows, rig, step, damping, robust).checkpoint()
        new_rig = rig.moved(step)
        new = _system(new_rows, new_rig, damping / 10, robust)
        if new[2] < cost:
            gain = (cost - new[2]) / max(cost, 1e-300)
            rows, rig, damping, (s, g, cost, squares, n) = new_rows, new_rig, damping / 10, new
            if gain < settle or cost < 1e-18 * max(n, 1):
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
            s, g, *_ = _system(rows, rig, damping, robust)
    poses = spark.createDataFrame([(c, *map(float, r.reshape(-1)), *map(float, t)) for c, r, t in zip(rig.ids, rig.r, rig.t)], "cam_id long, " + ", ".join(f"_{k} double" for k in (*(f"r{i}" for i in range(9)), "t0", "t1", "t2")))
    moved = cameras.join(F.broadcast(poses), "cam_id", "left")
    moved = moved.select(*(F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in poses.columns else F.col(c) for c in CAMERAS.names))
    rmse = lambda c: float(np.sqrt(c / max(n, 1)))
    return Result(rows.select(*WORLD_KEY, *XYZ), moved, rmse(before), rmse(squares), done)
