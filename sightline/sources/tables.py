"""Reading and writing the relations: CSV and Parquet tables, timestamps, cameras and constraints as TOML, TRC."""

from __future__ import annotations

import os
import tempfile
import tomllib
from collections.abc import Mapping
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline import schema
from sightline.operators.timing import dense_frame_index
from sightline.schema import CAMERAS


def read_points(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """A CSV with a header, validated; extra columns stay as text."""
    return schema.validate(spark.read.option("header", True).csv(path), kind)


def write_points_csv(points: DataFrame, path: str) -> None:
    """CSV parts with six decimals; Spark's committer makes all of it appear at once."""
    text = [F.format_string("%.6f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in points.dtypes]
    kept = [F.when(F.col(c).isNotNull(), e).alias(c) if t == "double" else e for (c, t), e in zip(points.dtypes, text)]
    points.select(*kept).write.mode("overwrite").option("header", True).csv(path)


def save_volume(path: str, image: DataFrame, world: DataFrame, cameras: DataFrame) -> None:
    """A capture volume: one Parquet table for each relation."""
    for name, df in (("image_points", image), ("world_points", world), ("cameras", cameras)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_volume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in ("image_points", "world_points", "cameras"))


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(cam_id, frame_index, frame_time): a stored sync_index is not read, frames are counted anew."""
    raw = spark.read.option("header", True).csv(path)
    return dense_frame_index(raw.select(F.col("cam_id").try_cast("long").alias("cam_id"), F.col("frame_time").try_cast("double").alias("frame_time")))


def write_timestamps(frames: DataFrame, path: str) -> None:
    frames.select("cam_id", "frame_time").sort("cam_id", "frame_time").write.mode("overwrite").option("header", True).csv(path)


def rotation_of(vector: Any) -> np.ndarray:
    """The matrix of a rotation given as a vector of three or as 3x3."""
    v = np.asarray(vector, dtype=float)
    if v.shape == (3, 3):
        return v
    v = v.reshape(3)
    angle = float(np.linalg.norm(v))
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def vector_of(r: np.ndarray) -> np.ndarray:
    """The rotation vector of a matrix, half turns too."""
    cos = np.clip((np.trace(r) - 1) / 2, -1, 1)
    angle = float(np.arccos(cos))
    w = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    if angle < 1e-9:
        return w / 2
    if np.pi - angle < 1e-6:
        m = (r + np.eye(3)) / 2
        axis = m[:, int(np.argmax(np.diag(m)))]
        return angle * axis / np.linalg.norm(axis)
    return angle / (2 * np.sin(angle)) * w


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """The rig's TOML: a handful of cameras. The text "null" is null, unknown keys are left out."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    rows = []
    for c in raw.get("cameras", {}).values():
        c = {k: v for k, v in c.items() if not (isinstance(v, str) and v == "null")}
        row: dict[str, Any] = dict.fromkeys(CAMERAS.names) | {"cam_id": int(c["cam_id"]), "ignored": bool(c.get("ignore", False)), "fisheye": bool(c.get("fisheye", False))}
        row["width"], row["height"] = map(int, c["size"])
        if "matrix" in c:
            m = np.asarray(c["matrix"], float)
            row |= {"fx": float(m[0, 0]), "fy": float(m[1, 1]), "cx": float(m[0, 2]), "cy": float(m[1, 2])}
        if "distortions" in c:
            d = np.asarray(c["distortions"], float).reshape(-1)
            row |= dict.fromkeys(("k1", "k2", "p1", "p2", "k3"), 0.0) | {k: float(v) for k, v in zip(("k1", "k2", "p1", "p2", "k3"), d)}
        if "rotation" in c and "translation" in c:
            r, t = rotation_of(c["rotation"]), np.asarray(c["translation"], float).reshape(-1)
            row |= {f"r{i}": float(x) for i, x in enumerate(r.reshape(-1))} | {f"t{i}": float(x) for i, x in enumerate(t)}
        rows.append(tuple(row[n] for n in CAMERAS.names))
    return spark.createDataFrame(rows, CAMERAS)


def toml_value(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(toml_value, value)) + "]"
    return f'"{value}"' if isinstance(value, str) else repr(value)


def write_toml(path: str, tables: Mapping[str, Mapping[str, Any]]) -> None:
    """Sections of plain values, nulls left out; the file is replaced at once."""
    replace_file(path, "\n".join(f"[{name}]\n" + "".join(f"{k} = {toml_value(v)}\n" for k, v in t.items() if v is not None) for name, t in tables.items()))


def replace_file(path: str, text: str) -> None:
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def write_cameras(cameras: DataFrame, path: str) -> None:
    """The rig's TOML, with rotation vectors and whether a camera is ignored."""
    out = {}
    for c in cameras.orderBy("cam_id").collect():  # a rig has tens of cameras
        t: dict[str, Any] = {"cam_id": c["cam_id"], "size": [c["width"], c["height"]], "ignore": bool(c["ignored"]), "fisheye": bool(c["fisheye"])}
        if c["fx"] is not None:
            t["matrix"] = [[c["fx"], 0.0, c["cx"]], [0.0, c["fy"], c["cy"]], [0.0, 0.0, 1.0]]
        if c["k1"] is not None:
            t["distortions"] = [c[k] for k in ("k1", "k2", "p1", "p2", *([] if c["fisheye"] else ["k3"]))]
        if c["r0"] is not None and c["t0"] is not None:
            t["rotation"] = vector_of(np.array([c[f"r{i}"] for i in range(9)]).reshape(3, 3)).tolist()
            t["translation"] = [c[f"t{i}"] for i in range(3)]
        out[f"cameras.{c['cam_id']}"] = t
    write_toml(path, out)


def write_aniposelib(cameras: DataFrame, path: str) -> None:
    """Posed cameras as aniposelib reads them: sections cam_N and metadata."""
    from sightline.operators.filters import posed

    out: dict[str, Any] = {}
    for c in posed(cameras).orderBy("cam_id").collect():
        r = np.array([c[f"r{i}"] for i in range(9)]).reshape(3, 3)
        out[f"cam_{c['cam_id']}"] = {
            "name": f"cam_{c['cam_id']}", "size": [c["width"], c["height"]], "matrix": None if c["fx"] is None else [[c["fx"], 0.0, c["cx"]], [0.0, c["fy"], c["cy"]], [0.0, 0.0, 1.0]],
            "distortions": None if c["k1"] is None else [c[k] for k in ("k1", "k2", "p1", "p2", *([] if c["fisheye"] else ["k3"]))], "rotation": vector_of(r).tolist(),
            "translation": [c[f"t{i}"] for i in range(3)], "fisheye": bool(c["fisheye"]),
        }
    write_toml(path, out | {"metadata": {"adjusted": False, "error": 0.0}})


DISTANCES = "constraint_id long, object_id_a long, keypoint_id_a long, object_id_b long, keypoint_id_b long, distance double, sigma double"


def write_constraints(distances: DataFrame, path: str) -> None:
    """Distance constraints, which are configuration, as one section each."""
    write_toml(path, {f"distances.{r['constraint_id']}": r.asDict() for r in distances.orderBy("constraint_id").collect()})


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    with open(path, "rb") as f:
        rows = tomllib.load(f).get("distances", {}).values()
    names = [x.split()[0] for x in DISTANCES.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DISTANCES)


def read_pose_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(cam_a, cam_b, r, t, error) from sections stereo_a_b."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    rows = []
    for name, c in raw.items():
        parts = name.split("_")
        if len(parts) == 3 and parts[0] == "stereo":
            r, t = rotation_of(c["rotation"]), np.asarray(c["translation"], float).reshape(-1)
            rows.append((int(parts[1]), int(parts[2]), r.reshape(-1).tolist(), t.tolist(), float(c["RMSE"])))
    return spark.createDataFrame(rows, "cam_a long, cam_b long, r array<double>, t array<double>, error double")


def write_pose_pairs(pairs: DataFrame, path: str) -> None:
    """Relative poses (cam_a, cam_b, r, t, error) as sections stereo_a_b, a < b, rotations as vectors."""
    rows = pairs.filter("cam_a < cam_b").orderBy("cam_a", "cam_b").collect()
    write_toml(path, {f"stereo_{r['cam_a']}_{r['cam_b']}": {"RMSE": r["error"], "rotation": vector_of(np.array(r["r"]).reshape(3, 3)).tolist(), "translation": list(r["t"])} for r in rows})


def wide_labelled(points: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """sync_index, frame_time and {name}_x, {name}_y, {name}_z of each named point, names in order.

    One row for each frame, null where a point isn't seen; of several objects' points the mean.
    """
    from sightline.operators.trajectories import wide

    times = points.groupBy("sync_index").agg(F.avg("frame_time").alias("frame_time"))
    columns = [f"{n}_{a}" for n in sorted(set(names.values())) for a in "xyz"]
    return wide(points, dict(names)).join(times, "sync_index").select("sync_index", "frame_time", *columns)


def write_wide_labelled(points: DataFrame, names: Mapping[int, str], path: str) -> None:
    """``wide_labelled`` as a CSV in the order of frames."""
    write_points_csv(wide_labelled(points, names).orderBy("sync_index"), path)


def load_timestamps(spark: SparkSession, folder: str, meta: DataFrame | None = None) -> DataFrame:
    """Frame times of a recording: those of ``timestamps.csv`` in its folder, else inferred from the
    cameras' frame counts and rates (``meta``) and kept beside it as ``inferred_timestamps.csv``."""
    from sightline.operators.timing import inferred_times

    try:
        return read_timestamps(spark, f"{folder.rstrip('/')}/timestamps.csv")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if meta is None or meta.isEmpty():
        raise ValueError("no timestamps, and no cameras to infer them from")
    found = inferred_times(meta)
    write_timestamps(found, f"{folder.rstrip('/')}/inferred_timestamps.csv")
    return found


def write_trc(wide: DataFrame, names: list[str], path: str, rate: float, units: str = "m") -> None:
    """An OpenSim table from wide points (sync_index, time, {name}_x...): five lines of header and one empty.

    The file is one ordered text by its format; rows come to the driver one partition at a
    time and are never all in memory. NumFrames is one short of the rows, as its readers expect.
    """
    n = wide.count()
    ordered = wide.orderBy("sync_index")
    with open(path, "w") as f:
        f.write(f"PathFileType\t4\t(X/Y/Z)\t{os.path.basename(path)}\n")
        f.write("DataRate\tCameraRate\tNumFrames\tNumMarkers\tUnits\tOrigDataRate\tOrigDataStartFrame\tOrigNumFrames\n")
        f.write(f"{rate:g}\t{rate:g}\t{n - 1}\t{len(names)}\t{units}\t{rate:g}\t0\t{n - 1}\n")
        f.write("Frame#\tTime\t" + "\t\t\t".join(names) + "\t\t\n")
        f.write("\t\t" + "\t".join(f"{a}{i + 1}" for i in range(len(names)) for a in "XYZ") + "\n\n")
        for i, row in enumerate(ordered.toLocalIterator()):
            values = [row[f"{m}_{a}"] for m in names for a in "xyz"]
            f.write("\t".join([str(i), f"{row['time']:.3f}", *("" if v is None else f"{v:.6f}" for v in values)]) + "\n")
