"""Target files: marker sets, boards and wireframes in TOML. Each is configuration of some tens of rows."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from sightline.sources.tables import replace_file, toml_value

MARKERS = "object_id long, side double, static boolean"
LINKS = "object_id_a long, corner_a int, object_id_b long, corner_b int, distance double, sigma double"
PAIRS = "object_id_a long, corner_a int, object_id_b long, corner_b int, thickness double, sigma double"
SEGMENTS = "name string, color string, point_a string, point_b string"
#: The keys of the files, in the order of the columns above.
MARKER_KEYS = ("id", "size_m", "static")
LINK_KEYS = ("marker_a", "corner_a", "marker_b", "corner_b", "distance_m", "sigma_m")
PAIR_KEYS = ("marker_a", "anchor_corner_a", "marker_b", "anchor_corner_b", "thickness_m", "sigma_m")
BOARD_DEFAULTS = {"dictionary": "DICT_4X4_50", "units": "inch", "aruco_scale": 0.75, "square_size_override_cm": None, "inverted": False, "legacy_pattern": False, "thickness_cm": 0.0}


@dataclass(frozen=True)
class MarkerSet:
    dictionary: int
    markers: DataFrame
    links: DataFrame
    pairs: DataFrame


def _load(path: str) -> dict[str, Any]:
    with open(path, "rb") as f:
        return tomllib.load(f)


def read_marker_set(spark: SparkSession, path: str) -> MarkerSet:
    """Links of the retired kind (corner_map, separation_m) are left out; missing corners and sigmas are null."""
    raw = _load(path)

    def rows(name: str, keys: tuple[str, ...], schema: str) -> DataFrame:
        kinds = [c.split()[1] for c in schema.split(", ")]
        held = [e for e in raw.get(name, []) if not {"corner_map", "separation_m"} & set(e)]
        value = lambda x, kind: float(x) if x is not None and kind == "double" else x
        return spark.createDataFrame([tuple(value(e.get(k, False if k == "static" else None), t) for k, t in zip(keys, kinds)) for e in held], schema)

    return MarkerSet(int(raw["dictionary"]), rows("markers", MARKER_KEYS, MARKERS), rows("links", LINK_KEYS, LINKS), rows("mirror_pairs", PAIR_KEYS, PAIRS))


def write_marker_set(found: MarkerSet, path: str) -> None:
    """Markers by id; nulls and ``static = false`` are left out."""
    parts = [f"dictionary = {found.dictionary}\n"]
    for name, table, keys in (("markers", found.markers.orderBy("object_id"), MARKER_KEYS), ("links", found.links, LINK_KEYS), ("mirror_pairs", found.pairs, PAIR_KEYS)):
        for r in table.collect():
            parts.append(f"[[{name}]]\n" + "".join(f"{k} = {toml_value(v)}\n" for k, v in zip(keys, r) if v is not None and not (k == "static" and not v)))
    replace_file(path, "\n".join(parts))


def read_board(path: str) -> dict[str, Any]:
    """A board's settings, those that are missing by default. A chessboard has rows, columns and square_size_cm alone."""
    raw = _load(path)
    if not {"columns", "rows"} <= set(raw):
        raise ValueError(f"{path} has no columns and rows")
    return {**BOARD_DEFAULTS, **raw} if "board_height" in raw else {"square_size_cm": None, **raw}


def write_board(board: Mapping[str, Any], path: str) -> None:
    """Settings without nulls."""
    replace_file(path, "".join(f"{k} = {toml_value(v)}\n" for k, v in board.items() if v is not None))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A wireframe's segments: a section each, but for ``points``."""
    rows = [(n, s["color"], *s["points"][:2]) for n, s in _load(path).items() if n != "points"]
    return spark.createDataFrame(rows, SEGMENTS)
