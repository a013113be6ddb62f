"""A rig of cameras on a ring that look at its middle: the dimension table of the demonstration queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sightline.schema import CAMERA_NUMBERS, CAMERAS

#: A made-up lens with every kind of distortion, and a made-up fisheye (four terms in k1, k2, p1, p2).
LENS = {"fx": 1301.37, "fy": 1308.91, "cx": 964.83, "cy": 536.27, "k1": 0.0913, "k2": -0.1837, "p1": 0.00153, "p2": -0.00211, "k3": 0.0619}
FISHEYE = {"fx": 701.43, "fy": 704.59, "cx": 955.71, "cy": 544.87, "k1": 0.0313, "k2": -0.008, "p1": 0.002, "p2": -0.0004, "k3": 0.0}


def look_at(position: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation from world (z up) to a camera (z ahead, y down) at ``position``."""
    ahead = (target - position) / np.linalg.norm(target - position)
    right = np.cross(ahead, [0.0, 0.0, 1.0])
    right /= np.linalg.norm(right)
    r = np.array([right, np.cross(ahead, right), ahead])
    return r, -r @ position


def ring(n: int = 4, radius: float = 2.0, height: float = 0.5, width: int = 1920, tall: int = 1080, ignored: tuple[int, ...] = (), unposed: tuple[int, ...] = (), fisheye: tuple[int, ...] = ()) -> list[dict]:
    """One dict for each camera, numbers rounded to 12 digits so that they read the same everywhere."""
    out = []
    for cam in range(n):
        turn = 2 * np.pi * cam / n
        r, t = look_at(np.array([radius * np.cos(turn), radius * np.sin(turn), height]), np.array([0.0, 0.0, height]))
        row = {"cam_id": cam, "width": width, "height": tall, **(FISHEYE if cam in fisheye else LENS)}
        row |= {f"r{i}": None if cam in unposed else round(float(x), 12) + 0.0 for i, x in enumerate(r.reshape(-1))}
        row |= {f"t{i}": None if cam in unposed else round(float(x), 12) + 0.0 for i, x in enumerate(t)}
        out.append(row | {"ignored": cam in ignored, "fisheye": cam in fisheye})
    return out


def cameras(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f.name] for f in CAMERAS) for r in rows], CAMERAS)


def cameras_sql(rows: list[dict]) -> str:
    """The same as VALUES for a query in plain SQL."""

    def value(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"

    names = ("cam_id", "width", "height", *CAMERA_NUMBERS, "ignored", "fisheye")
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(value(r[n]) for n in names) + ')' for r in rows)}) c({', '.join(names)})"
