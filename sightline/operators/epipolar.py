"""A rig's poses from matching points alone: essential matrices by consensus, a scaffold, resection of the other cameras."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.poses import _nearest_rotations, _turns
from sightline.operators.quantiles import quantiles
from sightline.operators.reconstruction import undistort
from sightline.schema import WORLD_KEY
from sightline.sources.checkpoints import use_checkpoints

#: Pixels that a match may be off; matches that a pair and a resection need; pairs that are tried as a scaffold at most.
INLIER_PIXELS, LEAST_MATCHES, LEAST_RESECTION, SCAFFOLDS = 3.0, 8, 50, 12
#: Below this ratio of its two largest singular values a pair's matrix is badly conditioned.
CONDITIONING_FLOOR = 0.5
#: Hypotheses for each pair or camera, drawn from so many of its matches; all matches vote.
HYPOTHESES, DRAWN_FROM = 500, 1024
#: Votes, hypotheses by matches, that a task holds at once.
CELLS = 1 << 17


def essential_of(rows: np.ndarray) -> np.ndarray:
    """Essential matrices (..., 3, 3) of groups of matches (..., n, 4), with equal first singular values."""
    a, b, c, d = (rows[..., k] for k in range(4))
    one = np.ones_like(a)
    m = np.stack([c * a, c * b, c, d * a, d * b, d, a, b, one], axis=-1)
    return _constrained(np.linalg.svd(m)[2][..., -1, :].reshape(*rows.shape[:-2], 3, 3))


def _constrained(e: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(e)
    return u * np.array([1.0, 1.0, 0.0]) @ vt


def conditioning(e: np.ndarray) -> float:
    """Ratio of the two largest singular values: near 1 for an essential matrix, lower the flatter the points."""
    s = np.linalg.svd(e)[1]
    return float(s[1] / s[0]) if s[0] > 1e-12 else 0.0


def sampson(e: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Distances (hypotheses, matches) of matches (n, 4) from the epipolar lines of matrices (h, 3, 3)."""
    p, q = np.column_stack([m[:, :2], np.ones(len(m))]), np.column_stack([m[:, 2:], np.ones(len(m))])
    line, back = np.einsum("hij,nj->hni", e, p), np.einsum("hij,ni->hnj", e, q)
    off = np.einsum("hni,ni->hn", line, q)
    return np.abs(off) / np.sqrt(np.maximum((line[..., :2] ** 2).sum(-1) + (back[..., :2] ** 2).sum(-1), 1e-300))


def agreeing(e: np.ndarray, m: np.ndarray, gate: float) -> np.ndarray:
    """How many matches lie within ``gate`` of the epipolar lines of each matrix: votes by ``sampson``, as products of matrices."""
    p, q = np.column_stack([m[:, :2], np.ones(len(m))]), np.column_stack([m[:, 2:], np.ones(len(m))])
    pairs = lambda x, y: (x[:, :, None] * y[:, None, :]).reshape(len(x), 9)
    off, length = pairs(q, p), np.column_stack([pairs(p, p), pairs(q, q)])
    line, back = np.einsum("hki,hkj->hij", e[:, :2], e[:, :2]), np.einsum("hik,hjk->hij", e[:, :, :2], e[:, :, :2])
    e, lengths = e.reshape(-1, 9).T, gate**2 * np.column_stack([line.reshape(-1, 9), back.reshape(-1, 9)]).T
    out, step = np.zeros(e.shape[1]), max(1, CELLS // e.shape[1])
    for lo in range(0, len(m), step):
        v = off[lo : lo + step] @ e
        out += (np.multiply(v, v, out=v) <= length[lo : lo + step] @ lengths).sum(axis=0)
    return out


def before_both(m: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether the lines of sight of matches are nearest to each other before both cameras, and not parallel."""
    p, q = np.column_stack([m[:, :2], np.ones(len(m))]), np.column_stack([m[:, 2:], np.ones(len(m))])
    d = p @ r.T
    dd, qq, dq, dt, qt = (d * d).sum(1), (q * q).sum(1), (d * q).sum(1), d @ t, q @ t
    det = dd * qq - dq * dq
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (qt * dq - dt * qq) / det
        return (det > 1e-24 * dd * qq) & (a > 0) & (a * dq + qt > 0)


def motions(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four rotations and directions that an essential matrix allows."""
    u, _, vt = np.linalg.svd(e)
    u, vt = u * np.sign(np.linalg.det(u)), vt * np.sign(np.linalg.det(vt))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(u @ x @ vt, s * u[:, 2]) for x in (w, w.T) for s in (1, -1)]


def intersect(m: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points in the first camera's frame, whether they are before both cameras and not at infinity)."""
    p, q = np.column_stack([m[:, :2], np.ones(len(m))]), np.column_stack([m[:, 2:], np.ones(len(m))])
    a = np.zeros((len(m), 4, 4))
    proj = np.column_stack([r, t])
    for k in range(2):
        a[:, k, k], a[:, k, 2] = -1.0, p[:, k]
        a[:, 2 + k] = q[:, k, None] * proj[2] - proj[k]
    x = np.linalg.svd(a)[2][:, -1]
    finite = np.abs(x[:, 3]) > 1e-12
    x = x[:, :3] / np.where(finite, x[:, 3], 1.0)[:, None]
    return x, finite & (x[:, 2] > 0) & ((x @ r.T + t)[:, 2] > 0)


@dataclass(frozen=True)
class PairPose:
    """Pose of the second camera before the first at baseline 1, and what speaks for it."""

    r: np.ndarray
    t: np.ndarray
    matches: int
    inliers: int
    before_both: int
    conditioning: float


def _sums(rows: DataFrame, by: tuple[str, ...], n: int) -> dict[tuple, np.ndarray]:
    """Arrays ``s`` of ``n`` numbers added up by key, before and after the shuffle; one row a key comes to the driver."""
    found = rows.groupBy(*by).agg(F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(n))).alias("s")).collect()
    return {tuple(r[c] for c in by): np.array(r["s"], dtype=float) for r in found}


def _by_key(rows: DataFrame, by: tuple[str, ...], fields: tuple[str, ...], work, n: int) -> dict[tuple, np.ndarray]:
    """The sums over all rows of the ``n`` numbers that ``work(key, values)`` gives for the rows of a key in a batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in by]) if batch.num_rows else np.zeros((0, len(by)), np.int64)
            values = np.column_stack([batch.column(c).to_numpy() for c in fields]) if batch.num_rows else np.zeros((0, len(fields)))
            for key in np.unique(keys, axis=0):
                s = work(tuple(key.tolist()), values[(keys == key).all(axis=1)])
                if s is not None:
                    yield pa.record_batch([*(pa.array([k], pa.int64()) for k in key), pa.array([np.asarray(s, float)], pa.list_(pa.float64()))], names=[*by, "s"])

    kinds = ", ".join(f"{c} long" for c in by) + ", s array<double>"
    return _sums(rows.select(*by, *fields).mapInArrow(run, kinds), by, n)


def _drawn(rows: DataFrame, by: tuple[str, ...], fields: tuple[str, ...], size: int, make, seed: int = 7) -> dict[tuple, np.ndarray]:
    """Hypotheses of each key from samples of ``size`` of DRAWN_FROM of its rows at most, those with the smallest hashes."""
    each = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    part = F.xxhash64(*fields, F.lit(seed)) / float(1 << 63)
    some = rows.join(F.broadcast(each), list(by)).filter((part + 1) / 2 <= 4 * DRAWN_FROM / F.col("_n"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(list(fields)).head(4 * DRAWN_FROM)
        x = pdf[list(fields)].to_numpy(float)
        rng = np.random.default_rng(seed)
        x = x[rng.permutation(len(x))[:DRAWN_FROM]]
        if len(x) < size:
            return pd.DataFrame(columns=[*by, "h"])
        samples = np.array([rng.choice(len(x), size, replace=False) for _ in range(HYPOTHESES)])
        made = make(x[samples])
        made = made[np.isfinite(made).all(axis=tuple(range(1, made.ndim)))]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), made.reshape(-1)]], columns=[*by, "h"])

    kinds = ", ".join(f"{c} long" for c in by) + ", h array<double>"
    return {tuple(r[c] for c in by): np.array(r["h"], dtype=float) for r in some.groupBy(*by).applyInPandas(run, kinds).collect() if len(r["h"])}


_MATCH, _PAIR = ("ax", "ay", "bx", "by"), ("cam_a", "cam_b")


def matches(points: DataFrame, cameras: DataFrame) -> DataFrame:
    """(cam_a, cam_b, sync_index, object_id, keypoint_id, ax, ay, bx, by): what two cameras that aren't ignored see at once, without distortion."""
    used = cameras.filter("not coalesce(ignored, false)")
    seen = undistort(points, used).filter("und_x is not null and und_y is not null and not isnan(und_x) and not isnan(und_y)")
    own = F.struct("cam_id", F.col("und_x").alias("x"), F.col("und_y").alias("y"))
    rows = seen.groupBy(*WORLD_KEY).agg(F.array_sort(F.collect_list(own)).alias("p")).filter(F.size("p") > 1)
    a = rows.select(*WORLD_KEY, "p", F.posexplode("p").alias("i", "a"))
    both = a.select(*WORLD_KEY, "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).filter("a.cam_id < b.cam_id")
    return both.select(F.col("a.cam_id").alias("cam_a"), F.col("b.cam_id").alias("cam_b"), *WORLD_KEY, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))


def pair_poses(found: DataFrame, focal: dict[int, float]) -> dict[tuple[int, int], PairPose]:
    """The pose of each pair with enough matches: hypotheses from samples, votes of all matches, fits to the
    inliers that more agree with, and of the four motions the one with most points before both cameras."""
    gate = lambda key: INLIER_PIXELS / (0.5 * (focal[key[0]] + focal[key[1]]))
    total = {tuple(r[:2]): r["n"] for r in found.groupBy(*_PAIR).agg(F.count("*").alias("n")).collect()}
    drawn = {k: h.reshape(-1, 3, 3) for k, h in _drawn(found, _PAIR, _MATCH, LEAST_MATCHES, essential_of).items() if total[k] >= LEAST_MATCHES}
    if not drawn:
        return {}

    def elect(candidates: dict[tuple, np.ndarray]) -> dict[tuple, int]:
        """Which candidate of each pair most matches agree with."""
        width = max(map(len, candidates.values()))

        def votes(key, m):
            if key not in candidates:
                return None
            out = np.zeros(width)
            out[: len(candidates[key])] = agreeing(candidates[key], m, gate(key))
            return out

        return {k: int(v[: len(candidates[k])].argmax()) for k, v in _by_key(found, _PAIR, _MATCH, votes, width).items()}

    won = {k: drawn[k][i] for k, i in elect(drawn).items()}
    ratio: dict[tuple, float] = {}
    for _ in range(4):

        def fit(key, m, won=won):
            """The equations of the matches within one and two gates, each weighted to its distance in the image."""
            if key not in won:
                return None
            off = sampson(won[key][None], m)[0]
            out = []
            for wide in (1, 2):
                a, b, c, d = own = m[off <= wide * gate(key)].T
                p, q = np.column_stack([a, b, np.ones(len(a))]), np.column_stack([c, d, np.ones(len(a))])
                weight = 1 / np.maximum(((p @ won[key].T)[:, :2] ** 2).sum(1) + ((q @ won[key])[:, :2] ** 2).sum(1), 1e-12)
                x = np.column_stack([c * a, c * b, c, d * a, d * b, d, a, b, np.ones(own.shape[1])])
                out.append((x.T @ (x * weight[:, None])).reshape(-1))
            return np.concatenate(out)

        plain = {k: [np.linalg.eigh(x.reshape(9, 9))[1][:, 0].reshape(3, 3) for x in (s[:81], s[81:])] for k, s in _by_key(found, _PAIR, _MATCH, fit, 162).items()}
        candidates = {k: np.array([won[k], *map(_constrained, plain[k])]) for k in won}
        won = {k: candidates[k][i] for k, i in elect(candidates).items()}
        ratio = {k: conditioning(x[0]) for k, x in plain.items()}

    def sides(key, m):
        if key not in won:
            return None
        m = m[sampson(won[key][None], m)[0] <= gate(key)]
        return [len(m), *(before_both(m, r, t).sum() for r, t in motions(won[key]))]

    out = {}
    for key, s in _by_key(found, _PAIR, _MATCH, sides, 5).items():
        best = int(s[1:].argmax())
        r, t = motions(won[key])[best]
        out[key] = PairPose(r, t, total[key], int(s[0]), int(s[1 + best]), ratio[key])
    return out


def _resected(x: np.ndarray) -> np.ndarray:
    """Poses (groups, 3, 4) of groups of (X, Y, Z, x, y), by direct linear transformation."""
    p = np.concatenate([x[..., :3], np.ones((*x.shape[:2], 1))], axis=2)
    zero = np.zeros_like(p)
    a = np.concatenate([np.concatenate([p, zero, -x[..., 3:4] * p], axis=2), np.concatenate([zero, p, -x[..., 4:5] * p], axis=2)], axis=1)
    return _rigid(np.linalg.svd(a)[2][:, -1].reshape(len(x), 3, 4))


def _rigid(h: np.ndarray) -> np.ndarray:
    scale = np.cbrt(np.linalg.det(h[:, :, :3]))
    h = h / np.where(np.abs(scale) < 1e-300, np.nan, scale)[:, None, None]
    good = np.isfinite(h).all(axis=(1, 2))
    out = np.full_like(h, np.nan)
    if good.any():
        out[good] = np.concatenate([_nearest_rotations(h[good][:, :, :3]), h[good][:, :, 3:]], axis=2)
    return out


def _off(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances (hypotheses, points) of what poses (h, 3, 4) make of (X, Y, Z, x, y); infinite behind the camera."""
    c = np.einsum("hij,nj->hni", p[:, :, :3], x[:, :3]) + p[:, None, :, 3]
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.linalg.norm(c[..., :2] / c[..., 2:] - x[:, 3:], axis=-1)
    return np.where(c[..., 2] > 1e-9, d, np.inf)


def _close(p: np.ndarray, x: np.ndarray, gate: float) -> np.ndarray:
    """How many of (X, Y, Z, x, y) each pose (h, 3, 4) puts within ``gate``: votes by ``_off``, as products of matrices."""
    at, rows = np.column_stack([x[:, :3], np.ones(len(x))]), [np.ascontiguousarray(p[:, k].T) for k in range(3)]
    out, step = np.zeros(len(p)), max(1, CELLS // len(p))
    for lo in range(0, len(x), step):
        own = at[lo : lo + step]
        a, b, z = (own @ r for r in rows)
        a -= x[lo : lo + step, 3:4] * z
        b -= x[lo : lo + step, 4:5] * z
        a *= a
        a += np.multiply(b, b, out=b)
        out += ((z > 1e-9) & (a <= np.multiply(z, z, out=b) * gate**2)).sum(axis=0)
    return out


@dataclass(frozen=True)
class Rig:
    """(rotation, translation) of each camera before the anchor, and how its scaffold fared."""

    anchor: int
    poses: dict[int, tuple[np.ndarray, np.ndarray]]
    pairs: dict[tuple[int, int], PairPose]
    scaffold: tuple[int, int]
    failures: int
    worst_error: float

    def before(self, cam: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The poses before another camera."""
        r0, t0 = self.poses[cam]
        return {c: (r @ r0.T, t - r @ r0.T @ t0) for c, (r, t) in self.poses.items()}


def bootstrap(points: DataFrame, cameras: DataFrame) -> Rig:
    """Poses of all cameras that points alone can give, up to scale: the baseline of the scaffold is 1.

    The pairs with most points before both cameras are scaffolds to choose from. Each gives a
    cloud, against which the other cameras are resected, all clouds and cameras at once; that one is taken with the fewest failures,
    then the smallest worst median error of a third camera, then most points. Null pixels don't match; two
    cameras have no third to tell by. ValueError if there are fewer than two cameras or no pair has enough matches.
    """
    use_checkpoints(points.sparkSession)
    found = matches(points, cameras).checkpoint()
    focal = {r["cam_id"]: r["fx"] for r in cameras.filter("fx is not null").select("cam_id", "fx").collect()}
    pairs = pair_poses(found, focal)
    if not pairs:
        raise ValueError(f"no two cameras share {LEAST_MATCHES} points, which an essential matrix needs")
    tried = sorted(pairs, key=lambda k: (-pairs[k].before_both, k))[:SCAFFOLDS]
    cams = sorted({c for k in pairs for c in k})
    gate = {k: INLIER_PIXELS / (0.5 * (focal[k[0]] + focal[k[1]])) for k in tried}
    cloud = _clouds(found, {k: pairs[k] for k in tried}, gate)
    sides = found.select(*WORLD_KEY, F.explode(F.array(F.struct(F.col("cam_a").alias("cam_id"), F.col("ax").alias("u"), F.col("ay").alias("v")), F.struct(F.col("cam_b").alias("cam_id"), F.col("bx").alias("u"), F.col("by").alias("v")))).alias("o"))
    seen = sides.select(*WORLD_KEY, "o.*").dropDuplicates([*WORLD_KEY, "cam_id"])
    third = cloud.join(seen, list(WORLD_KEY)).filter("cam_id <> cam_a and cam_id <> cam_b")
    enough = third.groupBy(*_PAIR, "cam_id").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_RESECTION).drop("n")
    third = third.join(F.broadcast(enough), [*_PAIR, "cam_id"]).checkpoint()
    poses, errors = _resections(third, focal)
    scores = {}
    for key in tried:
        own = [errors[*key, c] for c in cams if (*key, c) in errors]
        missing = len(cams) - 2 - len(own)
        scores[key] = (missing, max(own, default=0.0), -pairs[key].before_both, key)
    best = min(scores, key=scores.get)
    out = {best[0]: (np.eye(3), np.zeros(3)), best[1]: (pairs[best].r, pairs[best].t)}
    out |= {c: (poses[*best, c][:, :3], poses[*best, c][:, 3]) for c in cams if (*best, c) in errors}
    return Rig(best[0], out, pairs, best, scores[best][0], scores[best][1])


def _clouds(found: DataFrame, pairs: dict[tuple[int, int], PairPose], gate: dict[tuple[int, int], float]) -> DataFrame:
    """(cam_a, cam_b, key of the point, X, Y, Z): the points of each pair's inliers before both cameras."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_numpy() for c in _PAIR)
            m = np.column_stack([batch.column(c).to_numpy() for c in _MATCH])
            for key in pairs:
                at = (a == key[0]) & (b == key[1])
                if not at.any():
                    continue
                e = _cross(pairs[key].t) @ pairs[key].r
                own = np.flatnonzero(at)[sampson(e[None], m[at])[0] <= gate[key]]
                x, good = intersect(m[own], pairs[key].r, pairs[key].t)
                rows = batch.select([*_PAIR, *WORLD_KEY]).take(pa.array(own[good]))
                yield pa.record_batch([*rows.columns, *(pa.array(x[good][:, k]) for k in range(3))], names=[*_PAIR, *WORLD_KEY, "X", "Y", "Z"])

    return found.mapInArrow(work, "cam_a long, cam_b long, sync_index long, object_id long, keypoint_id long, X double, Y double, Z double")


def _cross(t: np.ndarray) -> np.ndarray:
    return np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])


def _resections(third: DataFrame, focal: dict[int, float]) -> tuple[dict[tuple, np.ndarray], dict[tuple, float]]:
    """By (cam_a, cam_b, cam_id): the pose of the third camera in the pair's cloud, and the median distance of its points."""
    by, fields = (*_PAIR, "cam_id"), ("X", "Y", "Z", "u", "v")
    drawn = {k: h.reshape(-1, 3, 4) for k, h in _drawn(third, by, fields, 6, _resected).items()}
    if not drawn:
        return {}, {}
    gate = lambda key: INLIER_PIXELS / focal[key[2]]

    def votes(key, x):
        if key not in drawn:
            return None
        out = np.zeros(HYPOTHESES)
        out[: len(drawn[key])] = _close(drawn[key], x, gate(key))
        return out

    poses = {k: drawn[k][int(v[: len(drawn[k])].argmax())] for k, v in _by_key(third, by, fields, votes, HYPOTHESES).items() if v.max() >= 6}
    for _ in range(6):

        def step(key, x):
            if key not in poses:
                return None
            p = poses[key]
            x = x[_off(p[None], x)[0] <= gate(key)]
            turned = x[:, :3] @ p[:, :3].T
            c = turned + p[:, 3]
            iz = 1 / c[:, 2]
            a, b, zero = c[:, 0] * iz, c[:, 1] * iz, np.zeros(len(x))
            d = np.concatenate([np.stack([iz, zero, -a * iz], axis=1), np.stack([zero, iz, -b * iz], axis=1)])
            jac = np.column_stack([np.cross(np.concatenate([turned, turned]), d), d])
            res = np.concatenate([a - x[:, 3], b - x[:, 4]])
            return np.concatenate([(jac.T @ jac).reshape(-1), jac.T @ res])

        moved = {}
        for key, s in _by_key(third, by, fields, step, 42).items():
            delta = -np.linalg.lstsq(s[:36].reshape(6, 6), s[36:], rcond=None)[0]
            r = _turns(delta[None, :3])[0] @ poses[key][:, :3]
            moved[key] = np.column_stack([r, poses[key][:, 3] + delta[3:]])
        poses = poses | moved

    def distances(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in by]
            x = np.column_stack([batch.column(c).to_numpy() for c in fields])
            off = np.full(len(x), np.inf)
            for key in poses:
                at = np.logical_and.reduce([k == v for k, v in zip(keys, key)])
                off[at] = _off(poses[key][None], x[at])[0]
            yield pa.record_batch([*(batch.column(c) for c in by), pa.array(off)], names=[*by, "off"])

    rows = third.select(*by, *fields).mapInArrow(distances, "cam_a long, cam_b long, cam_id long, off double")
    median = {tuple(r[c] for c in by): r["off"] for r in quantiles(rows, "off", (0.5,), by).collect()}
    return poses, {k: v for k, v in median.items() if k in poses}
