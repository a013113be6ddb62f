"""A scene for 3-D editors: cameras, trajectories and a wireframe as one nested JSON file.

Spark builds each frame's JSON, partition by partition; the driver writes frames one after
the other and never holds all of them. No program is started.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.filters import posed
from sightline.operators.trajectories import dense_trajectories

#: Digits of places in the file.
DIGITS = 5
#: Of keypoints without a segment, and of colours that the caller doesn't name.
UNGROUPED, GREY = "ungrouped", (0.5, 0.5, 0.5)


@dataclass(frozen=True)
class Group:
    name: str
    colour: tuple[float, float, float]
    columns: tuple[int, ...]


def camera_matrix(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Where a camera stands in the world, 4 x 4, for editors whose cameras look along -z with y up."""
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r.T * (1.0, -1.0, -1.0), -r.T @ t
    return out


def cameras_of(cameras: DataFrame, videos: Mapping[int, str] | None = None) -> list[dict]:
    """Posed cameras by id; a rig has tens of them. Those without a lens are left out."""
    out = []
    for c in posed(cameras).filter("fx is not null").orderBy("cam_id").collect():
        r, t = np.array([c[f"r{i}"] for i in range(9)]).reshape(3, 3), np.array([c[f"t{i}"] for i in range(3)])
        own = {"name": f"cam_{c['cam_id']}", "width": c["width"], "height": c["height"], "focal_px": (c["fx"] + c["fy"]) / 2, "cx": c["cx"], "cy": c["cy"]}
        out.append(own | {"matrix": camera_matrix(r, t).tolist(), "video": (videos or {}).get(c["cam_id"])})
    return out


def wire(keypoints: Sequence[int], segments: Sequence[tuple[str, str, str]], names: Mapping[str, int], colours: Mapping[str, tuple[float, float, float]]) -> tuple[list[Group], list[list[int]]]:
    """(groups of columns by colour, edges as pairs of columns) of ``segments`` (colour, point, point). A keypoint
    has the colour of its first segment; segments of points that nobody saw are left out."""
    at = {k: i for i, k in enumerate(keypoints)}
    ends = [(colour, at.get(names.get(a)), at.get(names.get(b))) for colour, a, b in segments]
    ends = [e for e in ends if None not in e]
    of = {}
    for colour, *both in ends:
        for column in both:
            of.setdefault(column, colour)
    columns = {}
    for i in range(len(keypoints)):
        columns.setdefault(of.get(i, UNGROUPED), []).append(i)
    return [Group(n, tuple(colours.get(n, GREY)), tuple(c)) for n, c in columns.items()], [list(e[1:]) for e in ends]


def scene_frames(points: DataFrame) -> DataFrame:
    """(sync_index, joints): of each frame of the most observed object, the place of each of its keypoints in
    order of ids, [x, y, z] to five digits. Gaps are held from before, then from after; static points and
    rows without a place are left out, keypoints that were never seen don't appear."""
    whole = points.dropna(subset=["x_coord", "y_coord", "z_coord"])
    # Only frames in which the object was seen.
    rows = dense_trajectories(whole, seen_only=True)
    place = F.array(*(F.round(c, DIGITS) + F.lit(0.0) for c in ("x_coord", "y_coord", "z_coord")))
    own = rows.groupBy("sync_index").agg(F.array_sort(F.collect_list(F.struct("keypoint_id", place.alias("p")))).alias("k"))
    return own.select("sync_index", F.col("k.keypoint_id").alias("keypoints"), F.col("k.p").alias("joints"))


def write_scene(
    points: DataFrame, cameras: DataFrame, path: str, fps: float, segments: Sequence[tuple[str, str, str]] = (), names: Mapping[str, int] | None = None,
    colours: Mapping[str, tuple[float, float, float]] | None = None, videos: Mapping[int, str] | None = None,
) -> None:
    """The scene's file, replaced at once. No frames or no posed cameras are an error."""
    from sightline.sources.checkpoints import use_checkpoints

    use_checkpoints(points.sparkSession)
    frames = scene_frames(points).checkpoint()
    first, rig = frames.first(), cameras_of(cameras, videos)
    if first is None or not rig:
        raise ValueError("nothing that moves to write" if rig else "no camera with a pose to write")
    groups, edges = wire(first["keypoints"], segments, names or {}, colours or {})
    parts = [F.to_json(F.array(*(F.get("joints", F.lit(i)) for i in g.columns))).alias(f"g{n}") for n, g in enumerate(groups)]
    rows = frames.select("sync_index", F.to_json("joints").alias("all"), *parts).orderBy("sync_index").checkpoint()
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as out:

        def listed(column: str) -> None:
            out.write("[")
            for i, r in enumerate(rows.select(column).toLocalIterator(prefetchPartitions=True)):
                out.write(("," if i else "") + str(r[0]))
            out.write("]")

        out.write('{"frames":')
        listed("sync_index")
        out.write(',"groups":[')
        for n, g in enumerate(groups):
            out.write(("," if n else "") + f'{{"name":{json.dumps(g.name)},"color":{json.dumps(list(g.colour))},"positions":')
            listed(f"g{n}")
            out.write("}")
        out.write('],"joints":')
        listed("all") if edges else out.write("[]")
        out.write("," + json.dumps({"edges": edges, "cameras": rig, "fps": float(fps)})[1:])
        out.flush()
        os.fsync(out.fileno())
    os.replace(temporary, path)
